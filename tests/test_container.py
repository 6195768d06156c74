"""Codec and container: round trips, hand-built files, known words."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe import file_queries
from reelframe.operators import blocks, combine, delta
from reelframe.plans import files
from reelframe.sources import codec, container, images, quicktime
from reelframe.streaming import decode as streaming


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([16, 24, 32]), st.integers(1, 700), st.integers(0, 2**31), st.sampled_from([0.02, 0.3, 0.9]))
def test_delta_round_trip(bpp, n, seed, share):
    rng = np.random.default_rng(seed)
    old = rng.integers(0, 4, n).astype(codec.pixel_type(bpp))
    new = np.where(rng.random(n) < share, rng.integers(0, 4, n), old).astype(old.dtype)
    data = (codec.encode16 if bpp == 16 else codec.encode32)(old, new)
    frame = old.copy()
    codec.apply_frame(frame, data, bpp, False)
    assert (frame == new).all()


def test_long_runs_split():
    for n in (16383 * 2 + 1, 16384, 70000):
        old, new = np.zeros(n, "<u2"), np.full(n, 7, "<u2")
        frame = old.copy()
        codec.decode16(codec.encode16(old, new), frame)
        assert (frame == new).all()
        new = np.arange(n).astype("<u2") | 1
        frame = old.copy()
        codec.decode16(codec.encode16(old, new), frame)
        assert (frame == new).all()


def test_known_words():
    assert codec.word32(codec.DUP, 2) == 0x900 and codec.word32(codec.DONE, 0) == 0x300
    assert codec.word16(codec.DUP, 2, 0xFFFF) == 0x4002FFFF and codec.word16(codec.COPY, 1, 0xFFFF) == 0x8001FFFF
    assert codec.generic_word(codec.COPY, 5, 1) == 2 << 30 | 1 << 16 | 5


def test_adler_pads_and_seeds_with_zero():
    px = np.array([1, 2, 3], "<u4")
    assert codec.adler(px, 24) == zlib.adler32(px.tobytes() + bytes(4), 0)
    assert codec.adler(np.zeros(4, "<u4"), 24) == 0xFFFFFFFF


def some_movie(n=12, frames=9, bpp=24, seed=1):
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 5, n).astype(codec.pixel_type(bpp))]
    for f in range(1, frames):
        px = out[-1].copy()
        if f % 3:
            px[rng.integers(0, n, 3)] = rng.integers(5, 9, 3)
        out.append(px)
    return out


def plain_file(kinds, datas, adlers, width, height, bpp, duration):
    """A whole version 3 file, laid out frame by frame."""
    page = lambda n: -(-n // codec.PAGE) * codec.PAGE
    at, entries, body = container.HEADER_SIZE + len(kinds) * container.ENTRY_V3.size, [], {}
    for kind, data, adler in zip(kinds, datas, adlers):
        if kind == "nop":
            offset, length, flags, _ = entries[-1]
            entries.append((offset, length, flags | container.NOP, 0))
            continue
        at = page(at) if kind == "key" else at
        entries.append((at, len(data), container.KEY if kind == "key" else 0, adler))
        body[at] = data
        at += len(data)
        at = page(at) if kind == "key" else at
    out = bytearray(at)
    head = container.pack_header(width, height, bpp, duration, len(kinds), "delta" not in kinds)
    start = head + b"".join(container.pack_entry(*e) for e in entries)
    out[: len(start)] = start
    for offset, data in body.items():
        out[offset : offset + len(data)] = data
    return bytes(out)


def build(px, bpp, width, height, every=10000):
    old, parts = None, []
    for i, p in enumerate(px):
        kind, data = codec.encode_frame(old, p, bpp, i % every == 0)
        parts.append((kind, data, 0 if kind == "nop" else codec.adler(p, bpp)))
        old = p
    kinds, datas, adlers = zip(*parts)
    return plain_file(list(kinds), list(datas), list(adlers), width, height, bpp, 1 / 24)


@pytest.mark.parametrize("bpp,every,n", [(16, 10000, 15), (24, 4, 12), (32, 10000, 15)])
def test_read_and_decode(spark, tmp_path, bpp, every, n):
    px = some_movie(n, bpp=bpp)
    (tmp_path / "a.anim").write_bytes(build(px, bpp, n, 1, every))
    head = container.read_movies(spark, str(tmp_path)).first()
    assert (head.movie, head.version, head.width, head.bpp, head.num_frames) == ("a.anim", 3, n, bpp, 9)
    got = container.read_pixels(spark, str(tmp_path)).orderBy("frame", "idx").collect()
    assert [r.px for r in got] == [int(x) for p in px for x in p]
    frames = container.read_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert all(f.offset % codec.PAGE == 0 for f in frames if f.is_key and not f.is_nop)
    assert [f.adler for f in frames if f.is_nop] == [0] * sum(f.is_nop for f in frames) and any(f.is_nop for f in frames)
    codes = container.packed_codes(container.read_frame_data(spark, str(tmp_path))).orderBy("frame").collect()
    assert [len(c.data) == 0 for c in codes] == [f.is_nop for f in frames]
    dumps = container.packed_pixels(container.decode(container.read_frame_data(spark, str(tmp_path))), n, 1).orderBy("frame").collect()
    assert bytes(dumps[0].data) == struct.pack("<II", n, 1) + px[0].tobytes()


@pytest.mark.parametrize("every", [10000, 3])
def test_encode_and_write_from_long_pixels(spark, tmp_path, every):
    px = some_movie()
    rows = [(m, f, i, int(x)) for m in ("a.anim", "b.anim") for f, p in enumerate(px) for i, x in enumerate(p)]
    long = spark.createDataFrame(rows, "movie string, frame long, idx long, px long")
    container.write_movies(container.encode(long, 24, every), str(tmp_path / "out"), 4, 3, 24, 1 / 24)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.anim", "b.anim"]
    assert (tmp_path / "out/a.anim").read_bytes() == (tmp_path / "out/b.anim").read_bytes() == build(px, 24, 4, 3, every)
    back = container.read_pixels(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    again = container.to_pixels(container.decode(container.read_frame_data(spark, str(tmp_path / "out"))))
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    spark.dataSource.register(container.AnimationSource)
    for table, count in (("movies", 2), ("frames", 18), ("frame_data", 18)):
        assert spark.read.format("animation").option("table", table).option("bytesPerPartition", "20000").load(str(tmp_path / "out")).count() == count


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_not_shuffled_by_movie_alone(spark, tmp_path):
    """Files: only the narrow index is dealt, by gop. Rows with payloads: by movie and frame, and by movie and gop."""
    (tmp_path / "a.anim").write_bytes(build(some_movie(), 24, 12, 1))
    plan = plan_of(container.decode_files(spark, str(tmp_path)))
    assert "hashpartitioning(path" in plan and "data#" not in plan[plan.index("Exchange") :]
    spark.createDataFrame([], container.FRAME_DATA).write.parquet(str(tmp_path / "rows"))
    data = spark.read.parquet(str(tmp_path / "rows"))
    plan = plan_of(container.decode(data)).splitlines()
    alone = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(movie#" in x and x.count("#") == 1]
    assert alone and not any("data#" in x for x in plan[alone[0] :])  # only the totals of blocks, of the narrow side
    encoded = plan_of(container.encode_frames(spark.createDataFrame([], "movie string, frame long, data binary"), 24))
    assert "Window" not in encoded


def test_first_frames_and_lengths_are_checked(spark, tmp_path):
    bad = spark.createDataFrame([("a", 0, "nop", 0, b""), ("a", 1, "key", 1, b"abcd")], container.ENCODED)
    with pytest.raises(Exception, match="nop"):
        container.write_movies(bad, str(tmp_path / "x"), 1, 1, 24, 1.0)
    one = spark.createDataFrame([("a", 0, "key", 1, b"abcd")], container.ENCODED)
    with pytest.raises(Exception, match="two frames"):
        container.write_movies(one, str(tmp_path / "y"), 1, 1, 24, 1.0)
    assert container.fits(0xFFFFFF, 2) and not container.fits(0x1000000, 2) and container.fits(0x1000000, 3)
    with pytest.raises(ValueError):
        container.pack_entry(0, 0x1000000, 1, 0, version=2)


def test_a_cut_file_is_an_error(spark, tmp_path):
    data = build(some_movie(), 24, 12, 1)
    (tmp_path / "a.anim").write_bytes(data[: codec.PAGE + 20])
    with pytest.raises(Exception, match="beyond the file"):
        container.read_frame_data(spark, str(tmp_path)).count()
    spark.dataSource.register(container.AnimationSource)
    with pytest.raises(Exception, match="beyond the file"):
        spark.read.format("animation").option("table", "frame_data").load(str(tmp_path)).count()
    (tmp_path / "a.anim").write_bytes(data[:100])
    with pytest.raises(Exception, match="beyond the file"):
        container.read_frames(spark, str(tmp_path)).count()


def test_version_2_index_and_refusals(spark, tmp_path):
    px = some_movie(4, 2)
    entries = b"".join(container.ENTRY_V2.pack(codec.PAGE * (i + 1), 16 << 8 | container.KEY, codec.adler(p, 24)) for i, p in enumerate(px))
    head = lambda version=2, frames=2, magic=container.MAGIC: container.HEADER.pack(magic, 4, 1, 24, 0.5, frames, version)
    got = container.read_index(entries, container.read_header(head()))
    assert [e["length"] for e in got] == [16, 16] and all(e["is_key"] and not e["is_nop"] for e in got)
    for bad in (head(magic=0), head(version=1), head(frames=1), head(version=9), b""):
        with pytest.raises(ValueError):
            container.read_header(bad)
    assert container.is_valid(head()) and not container.is_valid(head(magic=0))
    old = head(version=1) + entries
    old += bytes(codec.PAGE - len(old)) + b"".join(p.tobytes().ljust(codec.PAGE, b"\0") for p in px)
    (tmp_path / "old").mkdir()
    (tmp_path / "old/a.anim").write_bytes(old)
    (tmp_path / "new").mkdir()
    container.upgrade_movies(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert container.read_movies(spark, str(tmp_path / "new")).first().version == 3
    assert [r.px for r in container.read_pixels(spark, str(tmp_path / "new")).orderBy("frame", "idx").collect()] == [int(x) for p in px for x in p]
    with pytest.raises(ValueError, match="no upgrade"):
        container.upgrade_movies(spark, str(tmp_path / "new"), str(tmp_path / "new"))


def test_files_of_another_extension(spark, tmp_path):
    for name in ("a.anim", "b.bin"):
        (tmp_path / name).write_bytes(build(some_movie(), 24, 12, 1))
    assert container.read_movies(spark, str(tmp_path)).count() == 2
    assert container.read_movies(spark, str(tmp_path / "a.anim"), extension="anim").count() == 1
    for read in (container.read_movies, container.read_frames, container.read_frame_data, container.read_pixels):
        with pytest.raises(Exception, match="not a .anim file: b.bin"):
            read(spark, str(tmp_path), extension="anim").collect()


def test_files_of_any_size_are_listed(spark, tmp_path, monkeypatch):
    """A file beyond 2 GB, which no row holds, one of two bytes, and one in a folder below."""
    (tmp_path / "below").mkdir()
    (tmp_path / "below/b.anim").write_bytes(build(some_movie(), 24, 12, 1))
    (tmp_path / "c.anim").write_bytes(b"ab")
    with open(tmp_path / "a.anim", "wb") as f:
        f.write(struct.pack("<I", container.MAGIC))
        f.truncate((3 << 30) + 1)
    monkeypatch.setattr(files, "movies", lambda s, d: str(tmp_path))
    got = sorted(map(tuple, file_queries.QUERIES["container_files"](spark, "").collect()))
    assert got == [("a.anim", "BEBAFECA", False), ("b.anim", "BEBAFECA", True), ("c.anim", "6162", False)]


def test_wrong_checksum_is_found(spark, tmp_path):
    data = bytearray(build(some_movie(), 24, 12, 1))
    data[codec.PAGE] ^= 1
    (tmp_path / "a.anim").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        container.read_pixels(spark, str(tmp_path)).count()


def test_png_and_sequences(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, 12)
    c = [rng.integers(0, 256, 12) * a // 255 for _ in range(3)]
    px = (a << 24 | c[0] << 16 | c[1] << 8 | c[2]).astype(np.uint32)
    back, w, h = images.read_png(images.png(px, 4, 3, 32))
    assert (w, h) == (4, 3) and (back == px).all()
    plain = rng.integers(0, 1 << 24, 12).astype(np.uint32)
    for n in (3, 4, 5, 7):
        (tmp_path / f"F{n:04d}.png").write_bytes(images.png(plain + n, 4, 3, 24))
    got = images.decode_pictures(images.sequence_of(spark, str(tmp_path / "F0003.png"))).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1, 2]
    assert (np.frombuffer(got[1].data, "<u4") & 0xFFFFFF == plain + 4).all()
    frames = spark.createDataFrame([(i, 24, plain.astype("<u4").tobytes()) for i in range(2)], "frame int, bpp int, data binary")
    images.write_pictures(frames, str(tmp_path / "out"), 4, 3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["Frame0001.png", "Frame0002.png"]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (3, 12)).astype(np.uint8)
    coded, up = [], np.zeros(12, np.int64)
    for line in rows.astype(np.int64):
        out = []
        for i, x in enumerate(line):
            a, b, c = (line[i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            p = a + b - c
            guess = {1: a, 2: b, 3: (a + b) // 2, 4: min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]}[kind]
            out.append((x - guess) & 255)
        coded.append(np.array(out, np.uint8))
        up = line
    lines = np.concatenate([np.full((3, 1), kind, np.uint8), np.array(coded)], 1)
    assert (images.unfilter(lines, np.zeros(12, np.uint8), 3) == rows).all()
    assert (images.unfilter(lines[1:], rows[0], 3) == rows[1:]).all()


def make_png(width, height, depth, colour, raw, extra=(), interlaced=0):
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return images._SIGNATURE + images._chunk(b"IHDR", head) + b"".join(images._chunk(*x) for x in extra) + images._chunk(b"IDAT", zlib.compress(raw)) + images._chunk(b"IEND", b"")


def test_png_kinds():
    words = lambda data: [f"{x:08X}" for x in images.read_png(data)[0].tolist()]
    palette = (b"PLTE", bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]))
    assert words(make_png(3, 1, 2, 3, b"\0" + bytes([0b00011000]), [palette, (b"tRNS", bytes([255, 0, 51]))])) == ["FFFF0000", "00000000", "33000033"]
    assert words(make_png(3, 1, 1, 0, b"\0" + bytes([0b10100000]))) == ["FFFFFFFF", "FF000000", "FFFFFFFF"]
    assert words(make_png(2, 1, 4, 0, b"\0" + bytes([0x5F]), [(b"tRNS", b"\0\x05")])) == ["00000000", "FFFFFFFF"]
    assert words(make_png(2, 1, 8, 2, b"\0" + bytes([1, 2, 3, 4, 5, 6]), [(b"tRNS", bytes([0, 1, 0, 2, 0, 3]))])) == ["00000000", "FF040506"]
    assert words(make_png(1, 1, 16, 6, b"\0" + bytes([0x12, 0, 0x34, 0, 0x56, 0, 0xFF, 0xFF]))) == ["FF123456"]
    with pytest.raises(ValueError):
        images.read_png(make_png(1, 1, 4, 2, b"\0\0"))
    with pytest.raises(ValueError, match="palette"):
        images.read_png(make_png(1, 1, 8, 3, b"\0\x05", [palette]))
    with pytest.raises(ValueError, match="few rows"):
        images.read_png(make_png(1, 3, 8, 0, b"\0\x05"))


@pytest.mark.parametrize("width,height", [(1, 1), (5, 3), (8, 8), (13, 9)])
def test_interlaced_png(width, height):
    rng = np.random.default_rng(width)
    grey = rng.integers(0, 256, (height, width)).astype(np.uint8)
    raw = b""
    for x, y, dx, dy in images._PASSES:
        part = grey[y::dy, x::dx]
        if part.size:
            raw += b"".join(b"\0" + row.tobytes() for row in part)
    px, w, h = images.read_png(make_png(width, height, 8, 0, raw, interlaced=1))
    assert (w, h) == (width, height) and (px & 255 == grey.reshape(-1)).all()


def test_flat_pictures_are_checked(spark, tmp_path):
    px = some_movie(12, 4)
    frames = spark.createDataFrame([("m", f, p.tobytes()) for f, p in enumerate(px)], "movie string, frame long, data binary")
    images.write_flat(frames, str(tmp_path), 4, 3, 24, 4)
    back, w, h = images.read_png((tmp_path / "m.png").read_bytes())
    assert (w, h) == (4, 12) and ((back & 0xFFFFFF) == np.concatenate(px)).all()
    got = images.read_flat(spark, str(tmp_path), 4, 3).orderBy("frame").collect()
    assert [(np.frombuffer(r.data, "<u4") & 0xFFFFFF).tolist() for r in got] == [p.tolist() for p in px]
    for w, h in ((3, 4), (4, 5)):
        with pytest.raises(Exception, match="isn't made of frames"):
            images.read_flat(spark, str(tmp_path), w, h).count()
    with pytest.raises(Exception, match="are expected"):
        images.write_flat(frames, str(tmp_path / "x"), 4, 3, 24, 5)
    with pytest.raises(ValueError, match="16 bits"):
        images.write_flat(frames, str(tmp_path / "x"), 4, 3, 16, 4)


def test_a_sequence_of_one_is_an_error(spark, tmp_path):
    for n in (3, 5, 6):
        (tmp_path / f"F{n:04d}.png").write_bytes(images.png(np.zeros(4, np.uint32), 2, 2, 24))
    with pytest.raises(Exception, match="two files"):
        images.sequence_of(spark, str(tmp_path / "F0003.png")).count()
    assert images.sequence_of(spark, str(tmp_path / "F0005.png")).count() == 2


def test_a_sequence_goes_on_beyond_its_digits(spark, tmp_path):
    """9 is followed by 10 where names have one digit, 9999 by 10000 where they have four; 010 is no number of either."""
    for k, names in enumerate((("8", "9", "10", "11", "13"), ("9998", "9999", "10000", "10001", "010002"), ("9999998", "9999999", "10000000", "10000001"))):
        (tmp_path / str(k)).mkdir()
        for n in names:
            (tmp_path / f"{k}/F{n}.png").write_bytes(images.png(np.full(4, int(n), np.uint32), 2, 2, 24))
        got = images.decode_pictures(images.sequence_of(spark, str(tmp_path / f"{k}/F{names[0]}.png"))).orderBy("frame").collect()
        assert [(r.frame, int(np.frombuffer(r.data, "<u4")[0]) & 0xFFFFFF) for r in got] == [(i, int(names[0]) + i & 0xFFFFFF) for i in range(4)]


def two_movies(spark, change=None):
    rows = [(f, i, 10 * f + i) for f in range(3) for i in range(4)]
    other = [r for r in rows if r != change]
    return [spark.createDataFrame(r, "frame long, idx long, px long") for r in (rows, other)]


@pytest.mark.parametrize("operator", [combine.join_alpha, combine.differing, combine.overlay, combine.mix_straight])
def test_operators_on_two_movies_check_their_shapes(spark, operator):
    shape = {"width": 2, "height": 2, "bpp": 24, "frame_duration": 0.5, "num_frames": 3}
    a, b = two_movies(spark)
    if operator is combine.join_alpha:
        b = b.withColumn("px", b.px * 65793)
    assert operator(a, b, shapes=(shape, shape)).count() >= 0
    for field, value in (("width", 3), ("num_frames", 4), ("bpp", 16)):
        with pytest.raises(ValueError):
            operator(a, b, shapes=(shape, {**shape, field: value}))
    with pytest.raises(ValueError, match="bits"):
        operator(a, b, shapes=({**shape, "bpp": 16}, {**shape, "bpp": 16}))
    for part in (a.where("frame < 2"), a.where("frame < 2 or idx < 3")) if operator is not combine.mix_straight else (a.where("frame < 2"),):
        for pair in ((part, b), (b, part)):
            pair = [p.withColumn("px", p.px * 0) for p in pair]
            with pytest.raises(Exception, match="only one movie"):
                operator(*pair).collect()


def test_unmixing_needs_whole_pairs(spark):
    px = spark.createDataFrame([(f, i, 0) for f in range(3) for i in range(2)], "frame long, idx long, px long")
    with pytest.raises(Exception, match="odd number"):
        combine.unmix_alpha(px).collect()
    with pytest.raises(Exception, match="without its colours"):
        combine.unmix_alpha(px.where("frame > 0").withColumn("frame", px.frame)).where("frame >= 0").collect()


def test_blocks_give_what_windows_give(spark):
    rng = np.random.default_rng(5)
    rows = [(m, int(a), int(v) if v > 2 else None) for m in "ab" for a, v in zip(rng.permutation(300)[:200], rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "movie string, at long, v long")
    got = {(r.movie, r.at): (r.s, r.c) for r in blocks.carried(blocks.running_sum(df, ["movie"], "at", "v", "s", 7), ["movie"], "at", "v", "c", block=7).collect()}
    for m in "ab":
        total, last = 0, None
        for _, a, v in sorted((r for r in rows if r[0] == m), key=lambda r: r[1]):
            last = v if v is not None else last
            assert got[m, a] == (total, last)
            total += v or 0


def test_previous_pixels_across_blocks(spark):
    rows = [(f, i, f * 10 + i) for f in range(20) for i in range(3)]
    got = delta.with_previous(spark.createDataFrame(rows, "frame long, idx long, px long"), block=4).collect()
    assert sorted((r.frame, r.idx, r.px, r.old_px) for r in got) == [(f, i, p, p - 10 if f else None) for f, i, p in rows]


def test_quicktime_samples():
    def sample(header, body):
        return struct.pack(">IH", 6 + len(body), header) + body

    frame = np.zeros(8, np.uint32)
    body = b"\x01\x02" + bytes([1, 2, 3, 4, 5, 6]) + b"\xff" + b"\x02\xfd" + bytes([9, 9, 9]) + b"\xff" + b"\x00"
    quicktime.decode_sample(sample(0, body), frame, 4, 2, 24)
    assert frame.tolist() == [0x010203, 0x040506, 0, 0, 0, 0x090909, 0x090909, 0x090909]
    quicktime.decode_sample(sample(8, struct.pack(">HHHH", 1, 0, 1, 0) + b"\x01\x00\x03\x01" + bytes([7, 7, 7]) + b"\xff"), frame, 4, 2, 24)
    assert frame.tolist()[4:] == [0, 0x090909, 0x070707, 0x090909]
    frame16 = np.zeros(2, np.uint32)
    quicktime.decode_sample(sample(0, b"\x01\xfe\x7f\xff\xff"), frame16, 2, 1, 16)
    assert frame16.tolist() == [0x7FFF, 0x7FFF]
    frame32 = np.zeros(1, np.uint32)
    quicktime.decode_sample(sample(0, b"\x01\x01\x80\xff\x00\x10\xff"), frame32, 1, 1, 32)
    assert frame32.tolist() == [0x80800008]


def mov(samples, durations, bpp=24, **changes):
    data = files.quicktime_file(samples, durations, [0], 4, 2, bpp)
    for old, new in changes.get("replace", []):
        assert old in data
        data = data.replace(old, new, 1)
    return data


def test_quicktime_tables(spark, tmp_path):
    samples = [files._rle(np.arange(8, dtype=np.uint32) + i, None, 4, 24) for i in range(6)]
    data = mov(samples, [20, 20, 40, 20, 20, 20])
    got = quicktime.parse(data[data.index(b"moov") - 4 :])
    assert (got["width"], got["height"], got["bpp"], got["time_scale"]) == (4, 2, 24, 600)
    assert got["durations"] == [20, 20, 40, 20, 20, 20] and got["sizes"] == [len(s) for s in samples] and got["firsts"] == [(0, 4), (1, 2)] and got["sync"] == [1]
    (tmp_path / "a.mov").write_bytes(data)
    rows = quicktime.read_samples(spark, str(tmp_path)).orderBy("sample").collect()
    assert [data[r.file_offset : r.file_offset + r.size] for r in rows] == samples and {r.step for r in rows} == {20}
    frames = quicktime.decode_files(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.is_duplicate for r in frames] == [False, False, False, True, False, False, False]
    assert [np.frombuffer(r.data, "<u4").tolist() for r in frames] == [(np.arange(8) + i).tolist() for i in (0, 1, 2, 2, 3, 4, 5)]


@pytest.mark.parametrize(
    "old,new",
    [(b"mhlrvide", b"mhlrsoun"), (b"dhlralis", b"dhlrurl "), (b"dhlralis", b"mhlrvide"), (b"videappl", b"videxxxx"), (b"rle \0", b"jpeg\0"), (b"\x09Animation", b"\x05Video\0\0\0\0"), (b"\x00\x18\xff\xff", b"\x00\x18\x00\x08"), (b"\x00\x18\xff\xff", b"\x00\x08\xff\xff"), (b"stts", b"xxxx"), (b"\x00\x01\x00\x00", b"\x00\x02\x00\x00")],
)
def test_quicktime_refusals(old, new):
    data = mov([files._rle(np.zeros(8, np.uint32), None, 4, 24)] * 2, [20, 20])
    moov = data[data.index(b"moov") - 4 :]
    at = moov.index(old)
    if old == b"\x00\x01\x00\x00":
        at = moov.index(b"\x00\x01\x00\x00", moov.index(b"elst") + 12)
    bad = moov[:at] + new + moov[at + len(old) :]
    with pytest.raises(ValueError):
        quicktime.parse(bad)


def test_a_least_duration_of_one_is_refused(spark, tmp_path):
    (tmp_path / "a.mov").write_bytes(mov([files._rle(np.zeros(8, np.uint32), None, 4, 24)] * 2, [1, 20]))
    with pytest.raises(Exception, match="duration"):
        quicktime.decode_files(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="more than one track"):
        data = mov([b"123456"] * 2, [20, 20])
        moov = data[data.index(b"moov") + 4 :]
        quicktime.parse(struct.pack(">I4s", 8 + 2 * len(moov), b"moov") + moov * 2)


def test_streams_give_what_batches_give(spark, tmp_path):
    px = some_movie(12, 8)
    for part in range(2):
        frames = [("m", f, px[f].tobytes()) for f in range(part * 4, part * 4 + 4)]
        spark.createDataFrame(frames, "movie string, frame long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "whole"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        q.stop()
        return spark.sql(f"select * from {name}")

    whole = spark.readStream.schema("movie string, frame long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "whole"))
    coded = run(streaming.encode_stream(whole, 24), "coded").orderBy("frame").collect()
    old, expected = None, []
    for p in px:
        expected.append(codec.encode_frame(old, p, 24, old is None))
        old = p
    assert [(r.frame_class, bytes(r.data)) for r in coded] == expected
    rows = [("m", int(r.frame), r.frame_class == "key", r.frame_class == "nop", 12, 1, 24, bytes(r.data)) for r in coded]
    schema = "movie string, frame long, is_key boolean, is_nop boolean, width int, height int, bpp int, data binary"
    for lo in (0, 4):
        spark.createDataFrame(rows[lo : lo + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "stored"))
    stored = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stored"))
    back = run(streaming.decode_stream(stored), "back").orderBy("frame").collect()
    assert [bytes(r.data) for r in back] == [p.tobytes() for p in px]
