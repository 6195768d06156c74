"""Pixel relations derived from the star-schema tables, so that movies need no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _frames(df: DataFrame, key: str, size: int) -> DataFrame:
    """frame and idx by a dense key; an incomplete last frame is dropped. Its count is one aggregated row."""
    whole = df.agg(P.div(F.count("*"), size).alias("whole"))
    at = df.withColumn("frame", P.div(F.col(key), size)).withColumn("idx", F.pmod(F.col(key), F.lit(size)).cast("long"))
    return at.where(F.col("frame") < whole.scalar())


def _status_px():
    return F.when(F.col("o_orderstatus") == "F", 0xFF0000).when(F.col("o_orderstatus") == "O", 0x00FF00).otherwise(0x0000FF).cast("long")


def px_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10, 24 bits."""
    return _frames(orders(spark, sf_dir), "o_orderkey", 100).select("frame", "idx", _status_px().alias("px"))


def px_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 1, 24 bits."""
    return _frames(orders(spark, sf_dir), "o_orderkey", 2).select("frame", "idx", _status_px().alias("px"))


def px_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px_std with a black pixel where key % 17 = 0."""
    px = F.when(F.pmod("o_orderkey", F.lit(17)) == 0, 0).otherwise(_status_px()).cast("long")
    return _frames(orders(spark, sf_dir), "o_orderkey", 100).select("frame", "idx", px.alias("px"))


def px_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10, 32 bits, premultiplied."""
    a, k = F.pmod("o_custkey", F.lit(256)), F.col("o_orderkey")
    parts = [P.premultiply_component(F.pmod(k * m, F.lit(256)), a) for m in (37, 101, 13)]
    return _frames(orders(spark, sf_dir), "o_orderkey", 100).select("frame", "idx", P.pack(a, *parts).alias("px"))


def px_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray frames in wide form."""
    level = lambda e: F.least(F.greatest(F.floor(e * 128) + 128, F.lit(0)), F.lit(255)).cast("long")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda e: level(e) * 65793).alias("px"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = orders(spark, sf_dir).agg(F.count("*").alias("n"))
    rows = [("std", 10, 10, 24, 100), ("tiny", 2, 1, 24, 2), ("rgba", 10, 10, 32, 100)]
    made = spark.createDataFrame(rows, "movie string, width int, height int, bpp int, size int")
    return made.withColumn("n", n.scalar()).select("movie", F.lit(3).alias("version"), "width", "height", "bpp", (F.lit(1.0).cast("float") / F.lit(24.0).cast("float")).cast("float").alias("frame_duration"), P.div(F.col("n"), F.col("size")).cast("int").alias("num_frames"), F.lit(False).alias("all_keyframes"))


def fps_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", (F.lit(1.0).cast("float") / F.col("p_size").cast("float")).cast("float").alias("frame_duration"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", (F.lead(us).over(w) - us).alias("dur_us")).where("dur_us is not null")


def mov_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        k.alias("sample"), P.div(k, 4).alias("chunk"), (F.pmod(k * 7919, F.lit(4096)) + 1).alias("size"), (F.pmod(k, F.lit(3)) * 2 + 2).alias("dur")
    )
