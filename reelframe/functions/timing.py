"""Frame rates, cadences and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import div

#: The labels tried in order, each with the frame duration it stands for.
LABELS = [
    ("1/1", 1.0),
    ("2/1", 1 / 2),
    ("10/1", 1 / 10),
    ("12/1", 1 / 12),
    ("15/1", 1 / 15),
    ("1000/1001", 1001 / 1000),
    ("24/1", 1 / 24),
    ("30000/1001", 1001 / 30000),
    ("30/1", 1 / 30),
    ("50/1", 1 / 50),
    ("60000/1001", 1001 / 60000),
    ("60/1", 1 / 60),
]
TOLERANCE = 0.0001


def fps_label(duration: Column) -> Column:
    """The rate's label: the first common rate within the tolerance, else the duration in thousandths of a
    second, rounded up, over 1000. Values are compared as 32-bit floats, the fallback counts in 32-bit steps."""
    d = duration.cast("float").cast("double")
    out = F.concat(thousandths(d).cast("string"), F.lit("/1000"))
    for label, value in reversed(LABELS):
        out = F.when(F.abs(F.lit(value).cast("float").cast("double") - d) <= F.lit(TOLERANCE).cast("float").cast("double"), F.lit(label)).otherwise(out)
    return out


def thousandths(d: Column) -> Column:
    """The least i whose 32-bit product 0.001 * i reaches d: near d * 1000, so three candidates decide."""
    guess = F.greatest(F.floor(d * 1000).cast("int") - 1, F.lit(0))

    def reaches(i):
        return (F.lit(0.001).cast("float") * i.cast("float")).cast("float").cast("double") >= d

    out = guess + 3
    for k in (2, 1, 0):
        out = F.when(reaches(guess + k), guess + k).otherwise(out)
    return out


def parse_fps(text: Column) -> Column:
    """Frame duration (float seconds) of "FRAMES/SECONDS" or of a rate above 0 and below 90; null if it isn't valid."""
    clean = F.replace(text, F.lit(" "), F.lit(""))
    parts = F.split(clean, "/")
    number = F.try_element_at(parts, F.lit(1)).try_cast("float")
    second = F.try_element_at(parts, F.lit(2)).try_cast("float")
    pair = F.when((F.size(parts) == 2) & (number != 0), (second / number).cast("float"))
    return F.when(F.contains(clean, F.lit("/")), pair).otherwise(F.when((number > 0) & (number < 90), (F.lit(1.0).cast("float") / number).cast("float")))


def parse_frame_duration(text: Column) -> Column:
    number = text.try_cast("float")
    return F.when((number > 0) & (number < 90), number)


def is_cadence_keyframe(frame: Column, every: int = 10000) -> Column:
    """The first frame always; 0 and 1: all; n: each n-th. Below 0 it isn't valid."""
    if every < 0:
        raise ValueError("keyframe cadence must not be negative")
    return F.lit(True) if every <= 1 else F.pmod(frame, F.lit(every)) == 0


def trailing_nops(duration_us: Column, frame_us: int) -> Column:
    """Frames to repeat after one that is shown for duration_us: round(duration / frame) - 1, at least 0."""
    n = div(duration_us * 2 + frame_us, 2 * frame_us)
    return F.greatest(n - 1, F.lit(0)).cast("long")


def with_trailing_nops(frames: DataFrame, duration_us: str, frame_us: int) -> DataFrame:
    """frames and, after each, as many nop rows as its time needs: copy (from 0) and is_nop tell them apart."""
    copies = F.sequence(F.lit(0).cast("long"), trailing_nops(F.col(duration_us), frame_us))
    return frames.select("*", F.explode(copies).alias("copy")).withColumn("is_nop", F.col("copy") > 0)


def suffixed(name: Column, suffix: str) -> Column:
    """NAME.ext -> NAME<suffix>.ext."""
    return F.regexp_replace(name, r"(\.[^./]*)$", f"{suffix}$1")
