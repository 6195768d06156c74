"""Sharding by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes of a shard; hash bits; bits that a round adds to the directory's depth.
LIMIT_BYTES, BITS, ROUND = 256 << 10, 60, 12


def row_hash(*columns: str):
    """60 bits of the MD5 of a row's columns. Null counts as absent."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, BITS // 4), 16, 10).cast("long")


def prefix(depth):
    """The first `depth` bits of h."""
    return F.expr(f"shiftright(h, {BITS} - ({depth}))")


def assign_shards(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), size: str = "coalesce(octet_length(text), 0)", limit_bytes: int = LIMIT_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes, depth, prefix, shard and oversized of every row.

    A shard is a hash prefix of `depth` bits (the empty prefix is `root`). It is
    the shortest prefix whose rows' bytes are within the limit: only a bucket
    beyond it splits on another bit. The texts are read once, to write each
    row's kept columns, bytes and hash; all rounds read that narrow table. A
    round sums the bytes of the buckets still open by ROUND more bits, so the
    directory it makes has at most 2**ROUND rows for each open bucket; the first
    round's is broadcast, as 2**ROUND rows bound it. The hash is of the key and
    the text, so a key that holds many rows is split too. Only equal rows share
    all 60 bits; a bucket of those, or a single row, that is beyond the limit is
    a shard flagged oversized. Null text has no bytes, null columns count as
    absent in the hash; rows that repeat come out each; an empty table gives no
    rows. Other columns of docs, whatever their names, are ignored.
    """
    kept = [f"k{i}" for i in range(len(keep))]  # own names, so that none of the kept columns can clash
    rows = written(docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.expr(size).cast("long").alias("n_bytes"), row_hash(*columns).alias("h")))
    out, open_rows, depth = None, rows, 0
    while True:
        top = min(BITS, depth + ROUND)
        cells = written(open_rows.groupBy(prefix(top).alias("cell")).agg(F.sum("n_bytes").alias("b")))
        found = F.lit(None).cast("int")
        for d in range(top, depth, -1):
            total = F.sum("b").over(Window.partitionBy(F.expr(f"shiftright(cell, {top - d})")))
            found = F.when(total <= limit_bytes, d).otherwise(found)
        if depth == 0 and (cells.agg(F.sum("b")).first()[0] or 0) <= limit_bytes:
            found = F.lit(0)  # the whole table fits one shard
        directory = written(cells.select("cell", found.cast("int").alias("depth")))
        side = F.broadcast(directory) if depth == 0 else directory
        placed = open_rows.join(side, prefix(top) == F.col("cell")).drop("cell")
        done = placed.where("depth is not null") if top < BITS else placed.withColumn("oversized", F.col("depth").isNull()).withColumn("depth", F.coalesce("depth", F.lit(BITS)))
        if top < BITS:
            done = done.withColumn("oversized", F.lit(False))
        out = done if out is None else out.unionByName(done)
        if top == BITS or directory.where("depth is null").limit(1).count() == 0:
            break
        open_rows, depth = written(placed.where("depth is null").drop("depth")), top
    bits = prefix("depth")
    name = F.when(F.col("depth") == 0, F.lit("root")).otherwise(F.lpad(F.bin(bits), F.col("depth"), F.lit("0")))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "n_bytes", "depth", bits.alias("prefix"), name.alias("shard"), "oversized")
