"""Checksums, counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .delta import movie_of

ADLER_MOD = 65521


def frame_adler(pixels: DataFrame, frame_px: int, bpp: int = 24) -> DataFrame:
    """Adler-32 with seed 0 of each frame's bytes, as sums: s1 = sum(b), s2 = sum((n - i) * b), both mod 65521.

    Bytes are little-endian, 2 a pixel at 16 bits and else 4; an odd frame has
    one more zero pixel. 0 is given as 0xFFFFFFFF. Sums are partial before the
    shuffle. Each term is reduced, so that sums stay far below 2**63.
    """
    width = 2 if bpp == 16 else 4
    n = (frame_px + frame_px % 2) * width
    px, at = F.col("px"), F.col("idx") * width
    byte = [F.shiftright(px, 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(width)]
    s1 = sum(byte[1:], byte[0])
    s2 = sum(((F.lit(n) - at - k) * byte[k] for k in range(1, width)), (F.lit(n) - at) * byte[0])
    m = movie_of(pixels)
    sums = pixels.groupBy(*m, "frame").agg(F.sum(s1).alias("s1"), F.sum(F.pmod(s2, F.lit(ADLER_MOD))).alias("s2"))
    adler = F.pmod("s2", F.lit(ADLER_MOD)) * 65536 + F.pmod("s1", F.lit(ADLER_MOD))
    return sums.select(*m, "frame", F.when(adler == 0, F.lit(0xFFFFFFFF)).otherwise(adler).cast("long").alias("adler"))


def adler_with_nops(frames: DataFrame) -> DataFrame:
    """frames: frame, is_nop, adler -> adler of each frame, a nop repeating the last stored one, and its report text."""
    m = movie_of(frames)
    stored = frames.withColumn("_stored", F.when(~F.col("is_nop"), F.col("adler")))
    filled = blocks.carried(stored, m, "frame", "_stored", "_adler").drop("_stored")
    filled = filled.withColumn("adler", F.col("_adler")).drop("_adler")
    return filled.withColumn("report", F.concat(F.lit("0x"), F.hex("adler")))


def checksum_mismatches(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Frames whose stored checksum, where there is one, isn't the computed one; must be empty."""
    m = movie_of(stored)
    both = stored.select(*m, "frame", F.col("adler").alias("stored")).join(computed.select(*m, "frame", F.col("adler").alias("computed")), [*m, "frame"])
    return both.where("stored <> 0 and stored <> computed")


def histogram(pixels: DataFrame, mask: int | None = None) -> DataFrame:
    """px, count over all frames; with mask 0xFFFFFF by colour alone."""
    px = F.col("px") if mask is None else F.col("px").bitwiseAND(F.lit(mask).cast("long"))
    return pixels.groupBy(px.alias("px")).agg(F.count("*").alias("count"))


def by_frequency(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by pixel."""
    return counts.orderBy(F.desc("count"), "px")


def any_translucent(pixels: DataFrame) -> DataFrame:
    """has_alpha, and the bits that a movie of these pixels needs."""
    found = pixels.agg(F.coalesce(F.bool_or(F.shiftright("px", 24).bitwiseAND(F.lit(255).cast("long")) != 255), F.lit(False)).alias("has_alpha"))
    return found.withColumn("bpp", F.when(F.col("has_alpha"), 32).otherwise(24))


def all_keyframes(classes: DataFrame) -> DataFrame:
    """True if a movie has only key and nop frames."""
    m = movie_of(classes)
    flag = F.bool_and(F.col("frame_class").isin("key", "nop")).alias("all_keyframes")
    return classes.groupBy(*m).agg(flag) if m else classes.agg(flag)
