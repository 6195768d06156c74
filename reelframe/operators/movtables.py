"""Sample tables of QuickTime tracks, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pixels import div
from . import blocks
from .delta import movie_of

def start_times(samples: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """start_time: the sum of the durations of earlier samples of the movie."""
    return blocks.running_sum(samples, movie_of(samples), "sample", "dur", "start_time", block)


def frame_step(samples: DataFrame, strict: bool = False) -> DataFrame:
    """smallest: the least positive duration; total: the sum; largest_size; valid: a smallest duration of 1 is an
    error in a track. With strict it raises."""
    m = movie_of(samples)
    least = F.min(F.when(F.col("dur") > 0, F.col("dur")))
    found = (samples.groupBy(*m) if m else samples).agg(least.alias("smallest"), F.sum("dur").alias("total"), F.max("size").alias("largest_size"))
    if strict:
        found = found.withColumn("smallest", F.when(F.col("smallest") == 1, F.raise_error(F.lit("the least duration of a sample is 1")).cast("long")).otherwise(F.col("smallest")))
    return found.withColumn("valid", F.coalesce(F.col("smallest") != 1, F.lit(False)))


def frame_to_sample(samples: DataFrame, step: int | str) -> DataFrame:
    """frame, sample: frame i shows the sample in whose time i * step falls; step: a number, or the column of the
    movie's. A sample makes its own frames, so there is no range join."""
    m, timed = movie_of(samples), start_times(samples)
    step = F.col(step) if isinstance(step, str) else F.lit(step)
    first = div(F.col("start_time") + step - 1, step)
    last = div(F.col("start_time") + F.col("dur") + step - 1, step) - 1
    frames = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    return timed.select(*m, "sample", frames.alias("frame")).select(*m, "frame", "sample")


def chunk_counts(chunks: DataFrame, firsts: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """chunk, samples_per_chunk: that of the last entry (first_chunk, samples_per_chunk) at or before a chunk."""
    m = movie_of(chunks)
    entries = firsts.select(*m, F.col("first_chunk").alias("chunk"), F.lit(0).alias("is_chunk"), F.col("samples_per_chunk").cast("long").alias("n"))
    both = chunks.select(*m, "chunk", F.lit(1).alias("is_chunk"), F.lit(None).cast("long").alias("n")).unionByName(entries)
    return blocks.carried(both, m, "chunk", "n", "samples_per_chunk", "is_chunk", block).where("is_chunk = 1").select(*m, "chunk", "samples_per_chunk")


def sample_offsets(samples: DataFrame, chunk_offset: str = "chunk * 16384") -> DataFrame:
    """file_offset: the chunk's offset and the sizes of the chunk's earlier samples."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*movie_of(samples), "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return samples.withColumn("file_offset", F.expr(chunk_offset) + before)


def sync_flags(samples: DataFrame, sync: DataFrame | None) -> DataFrame:
    """is_key: whether the 1-based sample number is listed; without a list all are keys."""
    if sync is None:
        return samples.withColumn("is_key", F.lit(True))
    m = movie_of(samples)
    listed = sync.select(*m, (F.col("sample_id") - 1).alias("sample"), F.lit(True).alias("k")).distinct()
    return samples.join(listed, [*m, "sample"], "left").withColumn("is_key", F.coalesce("k", F.lit(False))).drop("k")
