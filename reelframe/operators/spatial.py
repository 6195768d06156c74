"""Changes of a frame's shape. All but `half` and `double` are one projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from .delta import movie_of


def xy(width: int):
    return F.pmod(F.col("idx"), F.lit(width)), P.div(F.col("idx"), width)


def crop(pixels: DataFrame, width: int, height: int, x: int, y: int, w: int, h: int) -> DataFrame:
    if x < 0 or y < 0 or w <= 0 or h <= 0 or x + w > width or y + h > height:
        raise ValueError(f"crop {x} {y} {w} {h} isn't inside {width} x {height}")
    cx, cy = xy(width)
    inside = pixels.where(cx.between(x, x + w - 1) & cy.between(y, y + h - 1))
    return inside.select(*movie_of(pixels), "frame", ((cy - y) * w + cx - x).cast("long").alias("idx"), "px")


def four_up(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """quadrant 1 to 4 (top left, top right, bottom left, bottom right), with places in the quadrant."""
    if width % 2 or height % 2:
        raise ValueError("width and height must be even")
    w, h = width // 2, height // 2
    cx, cy = xy(width)
    q = F.lit(1) + (cx >= w).cast("int") + (cy >= h).cast("int") * 2
    return pixels.select(*movie_of(pixels), q.alias("quadrant"), "frame", (F.pmod(cy, F.lit(h)) * w + F.pmod(cx, F.lit(w))).cast("long").alias("idx"), "px")


def double(pixels: DataFrame, width: int, bpp: int = 24) -> DataFrame:
    """Each pixel becomes 2 x 2."""
    if bpp == 16:
        raise ValueError("16 bits aren't supported")
    cx, cy = xy(width)
    corner = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2 * width), F.lit(2 * width + 1)))
    return pixels.select(*movie_of(pixels), "frame", (cy * 4 * width + cx * 2).alias("base"), corner.alias("corner"), "px").select(*movie_of(pixels), "frame", (F.col("base") + F.col("corner")).cast("long").alias("idx"), "px")


def half_box(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Half the size, each component the floor of the mean of 2 x 2. Our own definition: the platform's
    resampling is not reproducible. An odd last column or row is left out."""
    w, h = width // 2, height // 2
    cx, cy = xy(width)
    at = pixels.where((cx < 2 * w) & (cy < 2 * h)).withColumn("to", P.div(cy, 2) * w + P.div(cx, 2))
    px = F.col("px")
    sums = at.groupBy(*movie_of(pixels), "frame", "to").agg(*[F.shiftright(F.sum(fn(px)), 2).alias(n) for n, fn in (("a", P.alpha), ("r", P.red), ("g", P.green), ("b", P.blue))])
    return sums.select(*movie_of(pixels), "frame", F.col("to").alias("idx"), P.pack(F.col("a"), F.col("r"), F.col("g"), F.col("b")).alias("px"))


def resize_nearest(pixels: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """w x h by the nearest pixel at or before: our own definition for a size of choice. Each source pixel makes
    the target places whose source it is, so no join is needed."""
    cx, cy = xy(width)

    def targets(c, size, to):
        lo, hi = P.div(c * to + size - 1, size), P.div((c + 1) * to - 1, size)
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    rows = pixels.select(*movie_of(pixels), "frame", "px", targets(cx, width, w).alias("xs"), F.explode(targets(cy, height, h)).alias("ty"))
    return rows.select(*movie_of(pixels), "frame", F.explode("xs").alias("tx"), "ty", "px").select(*movie_of(pixels), "frame", (F.col("ty") * w + F.col("tx")).cast("long").alias("idx"), "px")


def flatten(pixels: DataFrame, frame_px: int, bpp: int = 24) -> DataFrame:
    """All frames under one another in one picture."""
    if bpp == 16:
        raise ValueError("16 bits aren't supported")
    return pixels.select(*movie_of(pixels), (F.col("frame") * frame_px + F.col("idx")).cast("long").alias("flat_idx"), "px")


def unflatten(flat: DataFrame, frame_px: int) -> DataFrame:
    return flat.select(*movie_of(flat), P.div(F.col("flat_idx"), frame_px).alias("frame"), F.pmod("flat_idx", F.lit(frame_px)).alias("idx"), "px")
