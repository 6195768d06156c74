"""Exhaustive and property tests of pixel arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import pixels as P
from reelframe.functions import timing
from reelframe.operators import combine, delta, movtables, spatial


def test_premultiply_and_back_for_all_levels(spark):
    rows = spark.range(65536).select(F.shiftright("id", 8).alias("a"), F.col("id").bitwiseAND(F.lit(255)).alias("c"))
    got = rows.select("a", "c", P.premultiply_component(F.col("c"), F.col("a")).alias("p"), P.unpremultiply(P.pack(F.col("a"), F.col("c"), F.col("c"), F.col("c"))).alias("u")).toPandas()
    assert (got.p == got.a * got.c // 255).all()
    valid = got[(got.c <= got.a) & (got.a > 0)]
    back = (valid.u & 255) * valid.a // 255
    assert (back == valid.c).all()
    assert (got[got.a == 0].u == 0).all()


def test_bytewise_add_undoes_subtract(spark):
    rng = np.random.default_rng(5)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"o": rng.integers(0, 2**32, 500), "n": rng.integers(0, 2**32, 500)}))
    assert df.where(P.add(F.col("o"), P.subtract(F.col("n"), F.col("o"))) != F.col("n")).count() == 0


@pytest.mark.parametrize(
    "fps,label", [(23.976, "24/1"), (30, "30000/1001"), (60, "60000/1001"), (25, "40/1000"), (20, "50/1000"), (8, "125/1000"), (5, "200/1000"), (48, "21/1000"), (1, "1/1"), (2, "2/1"), (24, "24/1"), (50, "50/1")]
)
def test_fps_labels(spark, fps, label):
    d = float(np.float32(1) / np.float32(fps))
    assert spark.range(1).select(timing.fps_label(F.lit(d))).first()[0] == label


def test_fps_parsing(spark):
    cases = {"24": 1 / 24, "24/1": 1 / 24, "30000 / 1001": 1001 / 30000, "0.5": 2.0, "0": None, "90": None, "0/1": None, "x": None, "1/2/3": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", timing.parse_fps(F.col("s")).alias("d"))
    for s, d in df.collect():
        assert (d is None) == (cases[s] is None) and (d is None or abs(d - cases[s]) < 1e-6), s


def movie(spark, frames):
    return spark.createDataFrame([(f, i, int(p)) for f, px in enumerate(frames) for i, p in enumerate(px)], "frame long, idx long, px long")


def test_runs_need_neighbours_within_an_island(spark):
    got = delta.runs(delta.delta_pixels(movie(spark, [[0] * 8, [7, 0, 7, 7, 9, 8, 0, 5]]))).orderBy("start_idx").collect()
    assert [(r.start_idx, r.num, r.op, r.px) for r in got] == [(0, 1, "COPY", [7]), (2, 2, "DUP", [7]), (4, 2, "COPY", [9, 8]), (7, 1, "COPY", [5])]


def test_skips_fold_to_255(spark):
    new = [0] * 400
    new[3] = 1
    got = delta.fold_skips(delta.codes(delta.delta_pixels(movie(spark, [[0] * 400, new])), 400)).orderBy("seq").collect()
    assert [(r.op, r.start_idx, r.num, r.skip_after) for r in got] == [("SKIP", 0, 3, 0), ("COPY", 3, 1, 255), ("SKIP", 259, 141, 0), ("DONE", 400, 0, 0)]


def test_bad_specs_are_refused(spark):
    px = movie(spark, [[0] * 4, [1] * 4])
    for spec in [(-1, 0, 1, 1), (0, 0, 0, 1), (0, 0, 1, 0), (1, 0, 2, 1)]:
        with pytest.raises(ValueError):
            spatial.crop(px, 2, 2, *spec)
    with pytest.raises(ValueError):
        combine.parse_alpha_map("256=1")
    with pytest.raises(ValueError):
        combine.check_same_shape({"width": 1}, {"width": 2}, ["width"])
    assert combine.parse_alpha_map("1=2,1=3") == {1: 3}


def test_gray_check_and_odd_frames_raise(spark):
    px = movie(spark, [[1] * 2, [2] * 2])
    with pytest.raises(Exception, match="gray"):
        combine.join_alpha(px, px).collect()
    with pytest.raises(Exception, match="odd"):
        combine.unmix_alpha(movie(spark, [[1], [0], [1]])).collect()


def test_half_undoes_double(spark):
    px = movie(spark, [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]])
    back = spatial.half_box(spatial.double(px, 3), 6, 4)
    assert sorted(back.select("frame", "idx", "px").collect()) == sorted(px.collect())


def test_an_empty_movie_goes_through(spark):
    px = movie(spark, [])
    assert delta.codes(delta.delta_pixels(px), 4).count() == 0
    assert combine.mix_alpha(px).count() == 0 and delta.frame_classes(px).count() == 0


def test_sample_tables_across_blocks(spark):
    rows = [(i, i // 3, 10 + i, 1 + i % 4) for i in range(60)]
    samples = spark.createDataFrame(rows, "sample long, chunk long, size long, dur long")
    got = dict(movtables.start_times(samples, block=7).select("sample", "start_time").collect())
    assert got == {i: sum(r[3] for r in rows[:i]) for i in range(60)}
    firsts = spark.createDataFrame([(0, 3), (2, 5), (15, 1)], "first_chunk long, samples_per_chunk long")
    got = dict(movtables.chunk_counts(samples.select("chunk").distinct(), firsts, block=4).collect())
    assert got == {c: 3 if c < 2 else 5 if c < 15 else 1 for c in range(20)}
    assert movtables.sync_flags(samples, None).where("not is_key").count() == 0
