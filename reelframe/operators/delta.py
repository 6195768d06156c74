"""Delta encoding and decoding of frames: lag, forward fill, runs and code rows.

Pixel tables have frame, idx, px and may have movie. Temporal steps part by
(movie, idx, block of frames) and run segmentation by (movie, frame), so a task
holds no more than a block of one pixel's history or one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pixels import div
from . import blocks

#: Frames of a block of a pixel's history.
FRAMES = 256


def movie_of(df: DataFrame) -> list[str]:
    return ["movie"] if "movie" in df.columns else []


def _by(df: DataFrame, *columns: str):
    return Window.partitionBy(*movie_of(df), *columns)


def with_previous(pixels: DataFrame, block: int = FRAMES) -> DataFrame:
    """old_px: the pixel at the same place one frame earlier, null in the first frame.

    Frames are dealt to blocks, and the last frame of a block goes to the next
    one too, so a task sorts no more than a block of a pixel's history.
    """
    at = div(F.col("frame"), block)
    last = F.pmod("frame", F.lit(block)) == block - 1
    to = F.explode(F.when(last, F.array(at, at + 1)).otherwise(F.array(at)))
    rows = pixels.select(*pixels.columns, to.alias("_block"))
    rows = rows.withColumn("old_px", F.lag("px").over(_by(pixels, "idx", "_block").orderBy("frame")))
    return rows.where(div(F.col("frame"), block) == F.col("_block")).drop("_block")


def delta_pixels(pixels: DataFrame) -> DataFrame:
    """The changed pixels: frame, idx, old_px, new_px. The first frame has no predecessor and no rows."""
    return with_previous(pixels).where("old_px is not null and px <> old_px").select(*movie_of(pixels), "frame", "idx", "old_px", F.col("px").alias("new_px"))


def frame_classes(pixels: DataFrame, keyframe_every: int = 10000) -> DataFrame:
    """frame, n_px, n_changed, frame_class: `key` by cadence or if every pixel changed, `nop` if none did, else `delta`."""
    from ..functions.timing import is_cadence_keyframe

    counted = with_previous(pixels).groupBy(*movie_of(pixels), "frame").agg(F.count("*").alias("n_px"), F.count_if(F.col("old_px") != F.col("px")).alias("n_changed"))
    key = is_cadence_keyframe(F.col("frame"), keyframe_every) | (F.col("frame") == 0)
    return counted.withColumn("frame_class", F.when(key | (F.col("n_changed") == F.col("n_px")), "key").when(F.col("n_changed") == 0, "nop").otherwise("delta"))


def islands(deltas: DataFrame) -> DataFrame:
    """Runs of consecutive changed places: frame, start_idx, num."""
    m = movie_of(deltas)
    rows = deltas.withColumn("isl", F.col("idx") - F.row_number().over(_by(deltas, "frame").orderBy("idx")))
    return rows.groupBy(*m, "frame", "isl").agg(F.min("idx").alias("start_idx"), F.count("*").alias("num")).drop("isl")


def runs(deltas: DataFrame) -> DataFrame:
    """frame, start_idx, num, op, px: within an island two or more equal neighbours are a DUP, the singles between make COPYs."""
    m = movie_of(deltas)
    rows = deltas.withColumn("isl", F.col("idx") - F.row_number().over(_by(deltas, "frame").orderBy("idx")))
    rows = rows.withColumn("first", F.coalesce((F.lag("new_px").over(_by(rows, "frame", "isl").orderBy("idx")) != F.col("new_px")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("first").over(_by(rows, "frame", "isl").orderBy("idx")))
    rows = rows.withColumn("dup", F.count("*").over(_by(rows, "frame", "isl", "run")) >= 2)
    # singles in a row share the number of DUP pixels before them
    rows = rows.withColumn("piece", F.when(F.col("dup"), F.col("run")).otherwise(-F.sum(F.col("dup").cast("long")).over(_by(rows, "frame", "isl").orderBy("idx")) - 1))
    return rows.groupBy(*m, "frame", "isl", "piece", "dup").agg(
        F.min("idx").alias("start_idx"), F.count("*").alias("num"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "new_px"))), lambda x: x["new_px"]).alias("all_px")
    ).select(*m, "frame", "start_idx", "num", F.when(F.col("dup"), "DUP").otherwise("COPY").alias("op"), F.when(F.col("dup"), F.slice("all_px", 1, 1)).otherwise(F.col("all_px")).alias("px"))


def codes(deltas: DataFrame, frame_px: int) -> DataFrame:
    """frame, seq, op, start_idx, num, px: the runs with SKIP for each gap, the last one too, and DONE at the end."""
    m = movie_of(deltas)
    r = runs(deltas)
    w = _by(r, "frame").orderBy("start_idx")
    r = r.withColumn("before", F.coalesce(F.lag(F.col("start_idx") + F.col("num")).over(w), F.lit(0))).withColumn("last", F.lead("start_idx").over(w).isNull())
    end, none = F.col("start_idx") + F.col("num"), F.array().cast("array<bigint>")

    def row(op, start, num, px):
        return F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), start.cast("long").alias("start_idx"), num.cast("long").alias("num"), px.alias("px"))

    parts = F.filter(
        F.array(
            row("SKIP", F.col("before"), F.col("start_idx") - F.col("before"), none),
            row(F.col("op"), F.col("start_idx"), F.col("num"), F.col("px")),
            row("SKIP", end, F.when(F.col("last"), F.lit(frame_px) - end).otherwise(0), none),
            row("DONE", F.lit(frame_px), F.when(F.col("last"), -1).otherwise(0), none),
        ),
        lambda x: x["num"] != 0,
    )
    out = r.select(*m, "frame", F.explode(parts).alias("c")).select(*m, "frame", "c.op", "c.start_idx", F.greatest("c.num", F.lit(0)).alias("num"), "c.px")
    order = _by(out, "frame").orderBy("start_idx", (F.col("op") == "DONE").cast("int"))
    return out.withColumn("seq", F.row_number().over(order).cast("long")).select(*m, "frame", "seq", "op", "start_idx", "num", "px")


def fold_skips(code_rows: DataFrame, most: int = 255) -> DataFrame:
    """A SKIP after a DUP or COPY folds up to 255 of its pixels into that code's skip_after; the rest stays a SKIP."""
    m = movie_of(code_rows)
    w = _by(code_rows, "frame").orderBy("seq")
    rows = code_rows.withColumn("next_skip", F.when(F.lead("op").over(w) == "SKIP", F.lead("num").over(w)).otherwise(0)).withColumn("after_run", F.lag("op").over(w).isin("DUP", "COPY"))
    run, skip = F.col("op").isin("DUP", "COPY"), F.col("op") == "SKIP"
    cut = F.when(skip & F.coalesce("after_run", F.lit(False)), F.least("num", F.lit(most))).otherwise(0)
    rows = rows.select(*m, "frame", "seq", "op", (F.col("start_idx") + cut).alias("start_idx"), (F.col("num") - cut).alias("num"), "px", F.when(run, F.least("next_skip", F.lit(most))).otherwise(0).cast("long").alias("skip_after"))
    rows = rows.where((F.col("op") != "SKIP") | (F.col("num") > 0))
    return rows.withColumn("seq", F.row_number().over(w).cast("long"))


def keyframe_and_delta_rows(pixels: DataFrame, keyframe_every: int = 10000) -> DataFrame:
    """What an encoder stores, in long form: all pixels of key frames, changed pixels of delta frames, none of nops."""
    m = movie_of(pixels)
    classes = frame_classes(pixels, keyframe_every).select(*m, "frame", "frame_class")
    stored = with_previous(pixels).join(classes, [*m, "frame"])
    return stored.where((F.col("frame_class") == "key") | ((F.col("frame_class") == "delta") & (F.col("px") != F.col("old_px")))).select(*m, "frame", "idx", "px")


def decode_fill(stored: DataFrame, frames: DataFrame, frame_px: int) -> DataFrame:
    """All pixels of all frames from stored rows: the last stored value of each place, a key frame restarting all.

    frames: frame and, if there are movies, movie. The grid of places is made
    by exploding a sequence, one row a pixel and frame, which is the result.
    """
    m = movie_of(frames)
    grid = frames.select(*m, "frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frame_px - 1).cast("long"))).alias("idx"))
    both = grid.join(stored, [*m, "frame", "idx"], "left")
    filled = blocks.carried(both, [*m, "idx"], "frame", "px", "_px", block=FRAMES)
    return filled.withColumn("px", F.col("_px")).drop("_px")


def gops(classes: DataFrame) -> DataFrame:
    """gop: the number of true keyframes (key, not nop) up to a frame. classes: frame, frame_class."""
    key = (F.col("frame_class") == "key").cast("long")
    return blocks.running_sum(classes, movie_of(classes), "frame", key, "_before").withColumn("gop", F.col("_before") + key).drop("_before")


def seek_start(classes: DataFrame, target: int) -> DataFrame:
    """The frame at which decoding must start to show `target`: the last keyframe up to it. One row a movie, by aggregation."""
    m = movie_of(classes)
    found = classes.where((F.col("frame_class") == "key") & (F.col("frame") <= target))
    return found.groupBy(*m).agg(F.max("frame").alias("start_frame")) if m else found.agg(F.max("frame").alias("start_frame"))


def duplicate_flags(classes: DataFrame) -> DataFrame:
    """is_duplicate: a frame that shows the same as the one before, read in order."""
    return classes.withColumn("is_duplicate", F.col("frame_class") == "nop")
