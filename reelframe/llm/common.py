"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session has none (tests on a local master) is a temporary
    folder made and set.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="reelframe-")
        spark.conf.set("spark.checkpoint.dir", at) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again (columnar, so later reads prune)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int):
    """True for the rows that no label may be learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


#: A key that holds more than one part in HOT of a table's rows is hot; there are fewer than HOT of those.
HOT = 1000


def split_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on `on`, where right has a row for each key with the number of left rows in `count`.

    Rows of hot keys are joined by broadcast, so none of them lands in one task:
    as only a key with more than total / HOT rows is hot, fewer than HOT rows are
    ever broadcast. All other keys are joined by shuffle.
    """
    hot = right.where(F.col(count) * HOT > total)
    cold = right.where(F.col(count) * HOT <= total)
    names = [c for c in right.columns if c not in on]
    marked = left.join(F.broadcast(hot.select(*on, F.struct(*names).alias("_hot"))), on, "left")
    first = marked.where("_hot is not null").select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in names])
    rest = marked.where("_hot is null").drop("_hot").join(cold.hint("merge"), on, how)
    return first.unionByName(rest.select(*first.columns))


def released(run: Callable) -> Callable:
    """run, with what a task's buffers held given back at its end: Spark uses a Python worker for many tasks, and an
    executor's memory is that of its JVM and its workers together."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[], Callable]) -> DataFrame:
    """mapInArrow over `columns`; fn() is called once a task and its result on each batch's dict of Arrow arrays.

    The result of a batch is a dict of lists or Arrow arrays, one for each field of `schema`.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            if not batch.num_rows:
                continue
            got = each({n: batch.column(i) for i, n in enumerate(columns)})
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow
            )

    return df.select(*columns).mapInArrow(released(run), out)


def stream_groups(df: DataFrame, key: list[str], order: list[str], schema: str, fn: Callable, partitions: int | None = None) -> DataFrame:
    """Bring the rows of a key together, in order, and hand them to fn as they stream by.

    fn(key values, iterator of row tuples) yields output tuples. Rows are read
    lazily, so only what fn keeps is in memory. The rows carry all columns of df.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names = to_arrow_schema(out), df.columns
    at = [names.index(k) for k in key]
    dealt = df.repartition(partitions, *key) if partitions else df.repartition(*key)

    def run(batches):
        def rows():
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        from itertools import groupby

        held = []
        for k, group in groupby(rows(), key=lambda r: tuple(r[i] for i in at)):
            for x in fn(k, group):
                held.append(x)
                if len(held) >= 2048:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    def pack(held):
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return dealt.sortWithinPartitions(*key, *order).mapInArrow(released(run), out)


def keep_rows(df: DataFrame, column: str, fn: Callable[[], Callable]) -> DataFrame:
    """The rows of df, all columns, for which the mask is true; fn() is called once a task, its result on each batch's `column`."""
    at = df.columns.index(column)

    def run(batches):
        each = fn()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(each(batch.column(at)), pa.bool_()))

    return df.mapInArrow(released(run), df.schema)
