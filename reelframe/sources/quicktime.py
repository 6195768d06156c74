"""QuickTime files with one Animation (run-length) track: atoms to sample tables, samples to frames.

A file's movie atom is read by one task and gives rows of its tables; samples
are placed by joins and windows (see operators.movtables) and their bytes are
read by range where a run of samples is decoded.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, movtables
from .container import DECODED, _files, _names, open_file, read_at

_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}


def uint(data: bytes, at: int, size: int = 4) -> int:
    """A big-endian unsigned number of `size` bytes."""
    return int.from_bytes(data[at : at + size], "big")


def atoms(data: bytes, lo: int = 0, hi: int | None = None):
    """(kind, start, stop) of all atoms, holders opened; a holder comes before what it holds."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        if size == 1:
            raise ValueError("64-bit atoms aren't supported")
        stop = hi if size == 0 else lo + size
        if size not in (0,) and size < 8 or stop > hi:
            raise ValueError(f"atom {kind!r} has a wrong size")
        yield kind, lo + 8, stop
        if kind in _HOLDERS:
            yield from atoms(data, lo + 8, stop)
        lo = stop


def _entries(data: bytes, at: int, form: str) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return [struct.unpack_from(f">{form}", data, at + 8 + i * struct.calcsize(f">{form}")) for i in range(n)]


def _description(data: bytes, at: int) -> tuple[int, int, int]:
    """width, height and depth of the one sample description."""
    if uint(data, at + 4) != 1 or data[at + 12 : at + 16] != b"rle ":
        raise ValueError("one Animation description is needed")
    entry = at + 8
    name = data[entry + 50 : entry + 82]
    if data[entry + 20 : entry + 24] != b"appl" or name[1 : 1 + name[0]] != b"Animation":
        raise ValueError("the description isn't that of the Animation codec")
    width, height = struct.unpack_from(">HH", data, entry + 32)
    depth, colours = struct.unpack_from(">HH", data, entry + 82)
    if depth not in (16, 24, 32):
        raise ValueError(f"depth {depth}")
    if colours != 0xFFFF:
        raise ValueError("a colour table isn't supported")
    return width, height, depth


def parse(data: bytes) -> dict:
    """width, height, bpp, time_scale, chunks (file offsets), firsts ((first_chunk, samples), from 0), sizes, durations, sync (1-based or None).

    One track is accepted, whose media handler (mhlr) is for video and whose
    data handler (dhlr) is an alias; both must be there.
    """
    out: dict = {"sync": None}
    handlers, tracks = set(), 0
    for kind, at, stop in atoms(data):
        if kind == b"trak":
            tracks += 1
            if tracks > 1:
                raise ValueError("more than one track")
        elif kind == b"hdlr":
            component, what, maker = (bytes(data[at + k : at + k + 4]) for k in (4, 8, 12))
            expected = {b"mhlr": b"vide", b"dhlr": b"alis"}.get(component)
            if expected is None or what != expected or maker != b"appl":
                raise ValueError(f"handler {component!r} {what!r} {maker!r} isn't supported")
            handlers.add(component)
        elif kind == b"mdhd":
            out["time_scale"] = uint(data, at + 12)
        elif kind == b"elst":
            edits = _entries(data, at, "III")
            if len(edits) != 1 or edits[0][1] or edits[0][2] != 0x10000:
                raise ValueError("only one edit from time 0 at rate 1 is supported")
        elif kind == b"stsd":
            out["width"], out["height"], out["bpp"] = _description(data, at)
        elif kind == b"stts":
            out["durations"] = [d for n, d in _entries(data, at, "II") for _ in range(n)]
        elif kind == b"stsc":
            out["firsts"] = [(c - 1, n) for c, n, _ in _entries(data, at, "III")]
        elif kind == b"stsz":
            same, n = uint(data, at + 4), uint(data, at + 8)
            out["sizes"] = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind == b"stco":
            out["chunks"] = [x for (x,) in _entries(data, at, "I")]
        elif kind == b"stss":
            out["sync"] = [x for (x,) in _entries(data, at, "I")]
    if handlers != {b"mhlr", b"dhlr"} or "bpp" not in out:
        raise ValueError("no Animation track")
    missing = [k for k in ("durations", "firsts", "sizes", "chunks") if k not in out]
    if missing:
        raise ValueError(f"no table of {', '.join(missing)}")
    return out


def movie_atom(file) -> bytes:
    """The moov atom of an open file; other atoms of the top level are stepped over."""
    at, end = 0, file.size()
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", read_at(file, at, 8))
        if size == 1:
            raise ValueError("64-bit atoms aren't supported")
        if kind == b"moov":
            return read_at(file, at, size or end - at, "the movie atom")
        if size == 0:
            break
        at += max(size, 8)
    raise ValueError("no movie atom")


TABLES = "movie string, path string, kind string, i bigint, a bigint, b bigint"


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables: kind shape (i 0: width, height; i 1: depth, time scale), size, dur, chunk, first, sync."""

    def run(batches):
        for batch in batches:
            for at, movie in zip(batch["path"], batch["movie"]):
                with open_file(at) as file:
                    got = parse(movie_atom(file))
                rows = [("shape", 0, got["width"], got["height"]), ("shape", 1, got["bpp"], got.get("time_scale", 0))]
                rows += [("size", i, x, None) for i, x in enumerate(got["sizes"])] + [("dur", i, x, None) for i, x in enumerate(got["durations"])]
                rows += [("chunk", i, x, None) for i, x in enumerate(got["chunks"])] + [("first", i, *x) for i, x in enumerate(got["firsts"])]
                rows += [("sync", i, x, None) for i, x in enumerate(got["sync"] if got["sync"] is not None else range(1, len(got["sizes"]) + 1))]
                for lo in range(0, len(rows), 65_536):
                    part = pd.DataFrame(rows[lo : lo + 65_536], columns=["kind", "i", "a", "b"], dtype=object)
                    part.insert(0, "movie", movie)
                    part.insert(1, "path", at)
                    yield part

    return _files(spark, path).mapInPandas(run, TABLES)


def samples_of(tables: DataFrame) -> DataFrame:
    """movie, path, sample, chunk, size, dur, file_offset, is_key, width, height, bpp, step of each sample.

    A chunk's number of samples is the last entry at or before it, its first
    sample the sum of the numbers before, and a sample's offset that of its
    chunk and the sizes of the chunk's earlier samples. step is the least
    duration, which must not be 1.
    """

    def table(kind, **columns):
        return tables.where(F.col("kind") == kind).select("movie", *[F.col(c).alias(n) for n, c in columns.items()])

    chunks, firsts = table("chunk", chunk="i", chunk_offset="a"), table("first", first_chunk="a", samples_per_chunk="b")
    counts = movtables.chunk_counts(chunks, firsts)
    begin = blocks.running_sum(counts, ["movie"], "chunk", "samples_per_chunk", "first_sample")
    many = F.when(F.col("samples_per_chunk") > 0, F.sequence(F.col("first_sample"), F.col("first_sample") + F.col("samples_per_chunk") - 1)).otherwise(F.array().cast("array<bigint>"))
    placed = begin.join(chunks, ["movie", "chunk"]).select("movie", "chunk", "chunk_offset", F.explode(many).alias("sample"))
    rows = placed.join(table("size", sample="i", size="a"), ["movie", "sample"]).join(table("dur", sample="i", dur="a"), ["movie", "sample"])
    rows = movtables.sync_flags(movtables.sample_offsets(rows, "chunk_offset"), table("sync", sample_id="a"))
    shape = tables.where("kind = 'shape'").groupBy("movie", "path").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).cast("int").alias(n) for n, i, c in (("width", 0, "a"), ("height", 0, "b"), ("bpp", 1, "a"))])
    steps = movtables.frame_step(rows, strict=True).select("movie", F.col("smallest").alias("step"))
    rows = rows.join(shape, "movie").join(steps, "movie")
    return rows.select("movie", "path", "sample", "chunk", "size", "dur", "file_offset", "is_key", "width", "height", "bpp", "step")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return samples_of(read_tables(spark, path))


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """movie, frame, bpp, is_duplicate, data: all frames of all files, whole.

    A frame shows the sample in whose time it falls. Samples from a sync sample
    to the next are decoded by one task, which reads their bytes by range and
    holds one framebuffer.
    """
    samples = read_samples(spark, path)
    key = F.col("is_key").cast("long")
    rows = blocks.running_sum(samples, ["movie"], "sample", key, "_before").withColumn("gop", F.col("_before") + key).drop("_before")
    shown = movtables.frame_to_sample(samples.select("movie", "sample", "dur", "size", "step"), "step").groupBy("movie", "sample").agg(F.min("frame").alias("frame"), F.count("*").alias("shown"))
    rows = rows.join(shown, ["movie", "sample"], "left").repartition("path", "gop").sortWithinPartitions("path", "gop", "sample")

    def run(batches):
        at = file = gop = frame = None
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.path != at:
                    if file:
                        file.close()
                    at, file = r.path, open_file(r.path)
                if (r.path, r.gop) != gop:
                    gop, frame = (r.path, r.gop), np.zeros(r.width * r.height, np.uint32)
                decode_sample(read_at(file, r.file_offset, r.size, f"sample {r.sample} of {r.movie}"), frame, r.width, r.height, r.bpp)
                data = frame.astype("<u2" if r.bpp == 16 else "<u4").tobytes()
                if not pd.isna(r.frame):
                    out += [(r.movie, int(r.frame) + k, r.bpp, k > 0, data) for k in range(int(r.shown))]
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=_names(DECODED))
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_names(DECODED))

    return rows.mapInPandas(run, DECODED)


def decode_sample(sample: bytes, frame: np.ndarray, width: int, height: int, bpp: int) -> None:
    """Apply a run-length sample to a framebuffer of pixel words; at 32 bits colours are premultiplied as they are read."""
    if len(sample) < 6:
        return
    (header,) = struct.unpack_from(">H", sample, 4)
    at, line, lines = 6, 0, height
    if header & 8:
        line, _, lines, _ = struct.unpack_from(">HHHH", sample, 6)
        at = 14
    size = bpp // 8

    def pixel(i):
        b = sample[i : i + size]
        if bpp == 16:
            return b[0] << 8 | b[1]
        if bpp == 24:
            return b[0] << 16 | b[1] << 8 | b[2]
        a = b[0]
        return a << 24 | (a * b[1] // 255) << 16 | (a * b[2] // 255) << 8 | a * b[3] // 255

    for y in range(line, line + lines):
        skip = sample[at]
        at += 1
        if skip == 0:
            return
        x = y * width + skip - 1
        while True:
            code = struct.unpack_from("b", sample, at)[0]
            at += 1
            if code == -1:
                break
            if code == 0:
                x += sample[at] - 1
                at += 1
            elif code < 0:
                frame[x : x - code] = pixel(at)
                x -= code
                at += size
            else:
                for _ in range(code):
                    frame[x] = pixel(at)
                    x += 1
                    at += size
