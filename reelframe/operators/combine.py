"""Operators on two channels or two movies. Joins are 1:1 on (movie, frame, idx), and what only one side has is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from .delta import movie_of


SHAPE = ("width", "height", "bpp", "frame_duration", "num_frames")


def shape_mismatches(a: DataFrame, b: DataFrame, fields=SHAPE) -> DataFrame:
    """field, first, second of what two movies (one row each, as read_movies gives) don't share; empty if they match."""
    both = a.select(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a")).join(b.select(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b")))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("first"), F.col(f"b.{f}").alias("second")) for f in fields]))
    return both.select(rows.alias("x")).select("x.*").where("not (first <=> second)")


def check_same_shape(a: dict, b: dict, fields=SHAPE) -> None:
    for f in fields:
        if a[f] != b[f]:
            raise ValueError(f"{f} must be the same: {a[f]} and {b[f]}")


def _checked(shapes, bpp: tuple[int, ...] = (), fields=SHAPE) -> None:
    """shapes: the headers of two movies as dicts, or None where only pixels are known."""
    if shapes:
        check_same_shape(*shapes, fields)
        for s in shapes:
            if bpp and s["bpp"] not in bpp:
                raise ValueError(f"{s['bpp']} bits a pixel aren't supported here")


def _zip(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Pixels side by side. A frame or a pixel that only one movie has is an error, so the join is a full one."""
    on = [*movie_of(a), "frame", "idx"]
    both = a.select(*on, F.struct("px").alias("_x")).join(b.select(*on, F.struct("px").alias("_y")), on, "full")
    alone = F.raise_error(F.concat(F.lit("only one movie has frame "), F.col("frame").cast("string"), F.lit(" pixel "), F.col("idx").cast("string")))
    return both.select(*on, *[F.when(F.col("_x").isNull() | F.col("_y").isNull(), alone.cast("long")).otherwise(F.col(f"{c}.px")).alias(n) for c, n in (("_x", x), ("_y", y))])


def split_rgb(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("px", P.rgb_only(F.col("px")))


def split_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("px", P.alpha_as_gray(F.col("px")))


def gray(px: Column) -> Column:
    """The level of an alpha pixel; raises on one that isn't gray."""
    return F.coalesce(P.gray_level(px), F.raise_error(F.concat(F.lit("alpha pixel isn't gray: "), F.hex(px))).cast("long"))


def _premultiplied(rgb: Column, level: Column) -> Column:
    return P.pack(level, *[P.premultiply_component(c, level) for c in (P.red(rgb), P.green(rgb), P.blue(rgb))])


def join_alpha(rgb: DataFrame, alpha: DataFrame, shapes=None) -> DataFrame:
    """32-bit pixels of a movie of colours and one of gray alpha, both of 24 bits and one shape; shapes: their headers."""
    _checked(shapes, (24,))
    both = _zip(rgb, alpha, "rgb", "mask")
    return both.select(*movie_of(rgb), "frame", "idx", _premultiplied(F.col("rgb"), gray(F.col("mask"))).alias("px"))


def mix_alpha(pixels: DataFrame) -> DataFrame:
    """Frame 2k holds the colours of frame k, 2k + 1 its alpha; one pass."""
    px = F.col("px")
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), P.rgb_only(px).alias("px")), F.struct(F.lit(1).alias("o"), P.alpha_as_gray(px).alias("px")))).alias("m")
    return pixels.select(*movie_of(pixels), (F.col("frame") * 2).alias("f"), "idx", both).select(*movie_of(pixels), (F.col("f") + F.col("m.o")).alias("frame"), "idx", "m.px")


def unmix_alpha(mixed: DataFrame) -> DataFrame:
    """The inverse, with one shuffle; a colour frame without its alpha frame is an error."""
    odd = F.pmod("frame", F.lit(2)) == 1
    both = mixed.groupBy(*movie_of(mixed), P.div(F.col("frame"), 2).alias("half"), "idx").agg(F.max(F.when(~odd, F.col("px"))).alias("rgb"), F.max(F.when(odd, F.col("px"))).alias("mask"))
    whole = F.coalesce(F.col("mask"), F.raise_error(F.lit("odd number of frames")).cast("long"))
    colour = F.coalesce(F.col("rgb"), F.raise_error(F.lit("an alpha frame without its colours")).cast("long"))
    return both.select(*movie_of(mixed), F.col("half").alias("frame"), "idx", _premultiplied(colour, gray(whole)).alias("px"))


def mix_straight(a: DataFrame, b: DataFrame, shapes=None) -> DataFrame:
    """Frames of a and b in turn. Both movies have 24 bits and as many frames: the frames' numbers, one row a frame,
    are compared, and one that only one movie has is an error."""
    _checked(shapes, (24,), ("width", "height", "num_frames"))
    m = movie_of(a)
    frames = [df.select(*m, "frame").distinct().withColumn(n, F.lit(1)) for df, n in ((a, "_a"), (b, "_b"))]
    alone = frames[0].join(frames[1], [*m, "frame"], "full").where("_a is null or _b is null").select(F.raise_error(F.concat(F.lit("only one movie has frame "), F.col("frame").cast("string"))).cast("long").alias("n"))
    found = alone.agg(F.max("n").alias("n"))  # one row, null where all is well
    a, b = (df.where(F.coalesce(found.scalar(), F.lit(0)) == 0) for df in (a, b))
    return a.withColumn("frame", F.col("frame") * 2).unionByName(b.withColumn("frame", F.col("frame") * 2 + 1))


def differing(original: DataFrame, modified: DataFrame, shapes=None) -> DataFrame:
    """frame, idx, old_px, new_px of the pixels that differ. Both movies have one shape and 24 or 32 bits."""
    _checked(shapes, (24, 32))
    return _zip(original, modified, "old_px", "new_px").where("old_px <> new_px")


def overlay(original: DataFrame, modified: DataFrame, shapes=None) -> DataFrame:
    """The modified movie with half red over each pixel that differs. Rounding is our own: each component is
    source + floor(component * 128 / 255)."""
    _checked(shapes, (24, 32))
    both = _zip(original, modified, "old_px", "px")
    px = F.col("px")
    under = [P.div(c * 128, 255) for c in (P.alpha(px), P.red(px), P.green(px), P.blue(px))]
    mark = P.pack(F.least(under[0] + 0x7F, F.lit(255)), F.least(under[1] + 0x7F, F.lit(255)), under[2], under[3])
    return both.select(*movie_of(original), "frame", "idx", F.when(F.col("old_px") != px, mark).otherwise(px).alias("px"))


def parse_alpha_map(spec: str) -> dict[int, int]:
    """"IN=OUT,..." of 0 to 255; the last of an equal IN counts."""
    out = {}
    for part in spec.split(","):
        left, sign, right = part.partition("=")
        if not sign or not (0 <= int(left) <= 255 and 0 <= int(right) <= 255):
            raise ValueError(f"alpha map entry {part!r} isn't IN=OUT with values from 0 to 255")
        out[int(left)] = int(right)
    return out


def alpha_map(pixels: DataFrame, spec: str) -> DataFrame:
    """Each alpha is looked up as it was, at most 256 entries as a map literal; colours stay. is_hit counts equal values too."""
    entries = parse_alpha_map(spec)
    table = F.create_map(*[F.lit(x).cast("long") for kv in entries.items() for x in kv])
    px = F.col("px")
    to = F.try_element_at(table, P.alpha(px))
    return pixels.select(*movie_of(pixels), "frame", "idx", (F.coalesce(to, P.alpha(px)) * 16777216 + P.opaque(px)).alias("px"), to.isNotNull().alias("is_hit"))
