"""The animation container: header, frame index and payloads, version 2 and 3 read, version 3 written.

A file's index is read by one task, in steps and without payloads; payloads are
read by byte range where they are used. Files are listed by Spark and opened
through pyarrow's file systems, so they can be in any store that both know.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pixels import div
from ..functions.timing import is_cadence_keyframe
from ..operators import blocks
from . import codec

#: Fixed values of the format.
MAGIC = 0xCAFEBABE
HEADER, ENTRY_V2, ENTRY_V3 = struct.Struct("<IIIIfII36x"), struct.Struct("<III"), struct.Struct("<QIIII")
HEADER_SIZE = HEADER.size
KEY, NOP, COMPRESSED = 1, 2, 4
ALL_KEYFRAMES = 0x2
MAX_LENGTH_V2, MAX_LENGTH_V3 = 0xFFFFFF, 0xFFFFFFFF
#: Index entries that are read at once, and frames whose payloads are read by one task.
ENTRIES, FRAMES_A_TASK = 65_536, 256

MOVIES = "movie string, version int, width int, height int, bpp int, frame_duration float, num_frames int, all_keyframes boolean"
FRAMES = "movie string, frame int, offset bigint, length bigint, is_key boolean, is_nop boolean, is_compressed boolean, adler bigint"
FRAME_DATA = FRAMES + ", width int, height int, bpp int, data binary"
INDEX = FRAMES + ", width int, height int, bpp int, gop bigint, path string"
DECODED = "movie string, frame int, bpp int, is_duplicate boolean, data binary"


def is_valid(data: bytes) -> bool:
    """Whether a file is whole: its magic is written last."""
    return len(data) >= HEADER.size and struct.unpack_from("<I", data)[0] == MAGIC


def fits(length: int, version: int) -> bool:
    """Whether an index entry can hold a payload's length."""
    return 0 <= length <= (MAX_LENGTH_V3 if version >= 3 else MAX_LENGTH_V2)


def read_header(data: bytes, upgrade: bool = False) -> dict:
    if len(data) < HEADER.size:
        raise ValueError("the file is shorter than a header")
    if not is_valid(data):
        raise ValueError("wrong magic: not a whole container")
    _, width, height, bpp, duration, frames, version = HEADER.unpack_from(data)
    if bpp not in (16, 24, 32):
        raise ValueError(f"{bpp} bits a pixel")
    if version & 0xFF < 2 and not upgrade:
        raise ValueError(f"version {version & 0xFF} must be upgraded")
    if version & 0xFF > 3:
        raise ValueError(f"unknown version {version & 0xFF}")
    if frames < 2:
        raise ValueError("a movie has two frames at least")
    return {"version": version & 0xFF, "width": width, "height": height, "bpp": bpp, "frame_duration": duration, "num_frames": frames, "all_keyframes": bool(version >> 8 & ALL_KEYFRAMES)}


def entry_size(head: dict) -> int:
    return ENTRY_V3.size if head["version"] == 3 else ENTRY_V2.size


def index_size(head: dict) -> int:
    return head["num_frames"] * entry_size(head)


def read_index(data: bytes, head: dict, first: int = 0) -> list[dict]:
    """Entries from `first` on, as many as data holds."""
    out = []
    for i in range(min(head["num_frames"] - first, len(data) // entry_size(head))):
        if head["version"] == 3:
            offset, length, flags, adler, _ = ENTRY_V3.unpack_from(data, i * ENTRY_V3.size)
        else:
            offset, both, adler = ENTRY_V2.unpack_from(data, i * ENTRY_V2.size)
            length, flags = both >> 8, both & 0xFF
        out.append({"frame": first + i, "offset": offset, "length": length, "is_key": bool(flags & KEY), "is_nop": bool(flags & NOP), "is_compressed": bool(flags & COMPRESSED), "adler": adler})
    return out


def open_file(path: str):
    """A file of any store that pyarrow knows, for reading at places."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_at(file, offset: int, length: int, what: str = "") -> bytes:
    """Exactly these bytes; a range beyond the file is an error."""
    data = file.read_at(length, offset) if length else b""
    if len(data) < length:
        raise ValueError(f"{what or 'a range'} ends beyond the file")
    return data


def entries_of(file, head: dict) -> Iterator[dict]:
    """The index, step by step, with the number of true keyframes up to each frame."""
    gop, size = 0, entry_size(head)
    for first in range(0, head["num_frames"], ENTRIES):
        n = min(ENTRIES, head["num_frames"] - first)
        for e in read_index(read_at(file, HEADER.size + first * size, n * size, "the index"), head, first):
            gop += e["is_key"] and not e["is_nop"]
            yield {**e, "gop": gop}


def _files(spark: SparkSession, path: str, extension: str | None = None, below: bool = False) -> DataFrame:
    """path and movie of the files, listed without their content; those of folders below too, if asked for. With an
    extension, a file of another is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("movie"))
    if extension:
        other = F.raise_error(F.concat(F.lit(f"not a .{extension} file: "), F.col("movie")))
        files = files.withColumn("movie", F.when(F.endswith("movie", F.lit(f".{extension}")), F.col("movie")).otherwise(other))
    return files


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _map(files: DataFrame, schema: str, rows) -> DataFrame:
    """rows(movie, open file, path) of each file, as tuples of `schema`."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, movie in zip(b["path"], b["movie"]):
                held = []
                with open_file(path) as file:
                    for r in rows(movie, file, path):
                        held.append(r)
                        if len(held) >= ENTRIES:
                            yield pd.DataFrame(held, columns=names, dtype=object)
                            held = []
                yield pd.DataFrame(held, columns=names, dtype=object)

    return files.mapInPandas(run, schema)


def _head(file, upgrade: bool = False) -> dict:
    return read_header(file.read_at(HEADER.size, 0), upgrade)


def read_movies(spark: SparkSession, path: str, upgrade: bool = False, extension: str | None = None) -> DataFrame:
    return _map(_files(spark, path, extension), MOVIES, lambda movie, file, _: [(movie, *_head(file, upgrade).values())])


def read_starts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """movie, length, start: each file at path or below with its first bytes. A file may be of any size: only those are read."""
    return _map(_files(spark, path, below=True), "movie string, length bigint, start binary", lambda movie, file, _: [(movie, file.size(), file.read_at(size, 0))])


def read_indexes(spark: SparkSession, path: str, upgrade: bool = False, extension: str | None = None) -> DataFrame:
    """The index rows with the movie's size, the frame's gop and the file's path."""

    def rows(movie, file, at):
        head = _head(file, upgrade)
        for e in entries_of(file, head):
            gop = e.pop("gop")
            yield (movie, *e.values(), head["width"], head["height"], head["bpp"], gop, at)

    return _map(_files(spark, path, extension), INDEX, rows)


def read_frames(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    return read_indexes(spark, path, extension=extension).select(*_names(FRAMES))


class _Payloads:
    """Payloads of index rows as they come; the file of the last row stays open."""

    def __init__(self):
        self.path = self.file = None

    def of(self, r) -> bytes:
        if r.path != self.path:
            if self.file:
                self.file.close()
            self.path, self.file = r.path, open_file(r.path)
        return b"" if r.is_nop else read_at(self.file, r.offset, r.length, f"frame {r.frame} of {r.movie}")


def read_frame_data(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """Index rows with payloads. The narrow index is dealt by file and run of frames; each task reads its ranges."""
    names = _names(FRAME_DATA)

    def run(batches):
        payloads = _Payloads()
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64].copy()
                part["data"] = [payloads.of(r) for r in part.itertuples()]
                yield part[names]

    index = read_indexes(spark, path, extension=extension)
    dealt = index.repartition("path", div(F.col("frame"), FRAMES_A_TASK)).sortWithinPartitions("path", "frame")
    return dealt.mapInPandas(run, FRAME_DATA)


class _Decoder:
    """Whole frames of rows that come gop by gop and in order; holds one framebuffer."""

    def __init__(self, verify: bool):
        self.verify, self.gop, self.frame = verify, None, None

    def step(self, r, data: bytes) -> tuple:
        if r.is_compressed:
            raise ValueError("compressed frames aren't supported")
        if (r.movie, r.gop) != self.gop:
            self.gop, self.frame = (r.movie, r.gop), np.zeros(r.width * r.height, codec.pixel_type(r.bpp))
        if not r.is_nop:
            codec.apply_frame(self.frame, data, r.bpp, r.is_key)
            if self.verify and r.adler and codec.adler(self.frame, r.bpp) != r.adler:
                raise ValueError(f"checksum of frame {r.frame} of {r.movie}")
        return r.movie, r.frame, r.bpp, r.is_nop, self.frame.tobytes()


def _decoded(rows: DataFrame, verify: bool, payload) -> DataFrame:
    """rows: sorted by movie, gop and frame within partitions that hold whole gops. payload() gives a row's bytes."""

    def run(batches):
        decoder, data = _Decoder(verify), payload()
        for b in batches:
            out = []
            for r in b.itertuples():
                out.append(decoder.step(r, data(r)))
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=_names(DECODED))
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_names(DECODED))

    return rows.mapInPandas(run, DECODED)


def decode_files(spark: SparkSession, path: str, verify: bool = True, upgrade: bool = False, extension: str | None = None) -> DataFrame:
    """movie, frame, bpp, is_duplicate, data: every frame whole, from files.

    The narrow index is dealt by gop (the frames from a keyframe to the next),
    and each task reads and decodes its gops' payloads: payloads aren't shuffled,
    and a movie's gops decode in parallel.
    """
    index = read_indexes(spark, path, upgrade, extension).repartition("path", "gop").sortWithinPartitions("path", "gop", "frame")
    return _decoded(index, verify, lambda: _Payloads().of)


def decode(frame_data: DataFrame, verify: bool = True) -> DataFrame:
    """movie, frame, bpp, is_duplicate, data: every frame whole, from rows that hold their payloads.

    Gops are found on the narrow columns, by blocks, and joined back on movie
    and frame; the payloads are shuffled by movie and gop, never by movie alone.
    """
    key = (F.col("is_key") & ~F.col("is_nop")).cast("long")
    narrow = frame_data.select("movie", "frame", key.alias("k"))
    gop = blocks.running_sum(narrow, ["movie"], "frame", "k", "before").select("movie", "frame", (F.col("before") + F.col("k")).alias("gop"))
    rows = frame_data.join(gop, ["movie", "frame"]).repartition("movie", "gop").sortWithinPartitions("movie", "gop", "frame")
    return _decoded(rows, verify, lambda: lambda r: r.data)


def to_pixels(decoded: DataFrame) -> DataFrame:
    """movie, frame, idx, px from whole frames."""

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                px = np.frombuffer(r.data, codec.pixel_type(r.bpp)).astype("int64")
                yield pd.DataFrame({"movie": r.movie, "frame": np.int64(r.frame), "idx": np.arange(len(px)), "px": px})

    return decoded.mapInPandas(run, "movie string, frame bigint, idx bigint, px bigint")


def read_pixels(spark: SparkSession, path: str, verify: bool = True, extension: str | None = None) -> DataFrame:
    return to_pixels(decode_files(spark, path, verify, extension=extension))


ENCODED = "movie string, frame bigint, frame_class string, adler bigint, data binary"


def encode_frames(frames: DataFrame, bpp: int, keyframe_every: int = 10000) -> DataFrame:
    """movie, frame, frame_class, adler, data (payload) from whole frames (movie, frame, data).

    A frame meets the one before by a join on movie and frame - 1, so a task
    holds two frames and no movie is gathered. Frames are numbered without gaps.
    """
    now = frames.select("movie", F.col("frame").cast("long").alias("frame"), "data")
    before = now.select("movie", (F.col("frame") + 1).alias("frame"), F.col("data").alias("old"))
    both = now.join(before, ["movie", "frame"], "left").withColumn("key", is_cadence_keyframe(F.col("frame"), keyframe_every))

    def run(batches):
        kind = codec.pixel_type(bpp)
        for b in batches:
            out = []
            for r in b.itertuples():
                new = np.frombuffer(r.data, kind)
                old = None if r.old is None else np.frombuffer(r.old, kind)
                name, data = codec.encode_frame(old, new, bpp, bool(r.key))
                out.append((r.movie, int(r.frame), name, 0 if name == "nop" else codec.adler(new, bpp), data))
            yield pd.DataFrame(out, columns=_names(ENCODED))

    return both.select("movie", "frame", "data", "old", "key").mapInPandas(run, ENCODED)


def whole_frames(pixels: DataFrame, bpp: int) -> DataFrame:
    """movie, frame, data: each frame's pixels as bytes, from long pixels. A task holds a frame."""
    px = F.transform(F.array_sort(F.collect_list(F.struct("idx", "px"))), lambda x: x["px"])
    wide = pixels.groupBy("movie", "frame").agg(px.alias("px"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"movie": b["movie"], "frame": b["frame"], "data": [np.asarray(x, codec.pixel_type(bpp)).tobytes() for x in b["px"]]})

    return wide.mapInPandas(run, "movie string, frame bigint, data binary")


def encode(pixels: DataFrame, bpp: int, keyframe_every: int = 10000) -> DataFrame:
    return encode_frames(whole_frames(pixels, bpp), bpp, keyframe_every)


def _padded(size, page: int = codec.PAGE):
    return div(size + page - 1, page) * page


def layout(frames: DataFrame) -> DataFrame:
    """movie, frame, frame_class, offset, length, flags, adler, end, num_frames of frames (movie, frame, frame_class, length, adler).

    Keyframes start at a page and are padded to one, deltas follow on, nops
    repeat the entry before with checksum 0. A gop starts at a page, so its
    place is the sum of the pages of the gops before, and a frame's place in it
    the sum of the frames before. All of it is on the narrow index.
    """
    key = (F.col("frame_class") == "key").cast("long")
    rows = blocks.running_sum(frames.withColumn("_k", key), ["movie"], "frame", "_k", "_before").withColumn("gop", F.col("_before") + F.col("_k")).drop("_before", "_k")
    size = F.when(F.col("frame_class") == "key", _padded(F.col("length"))).when(F.col("frame_class") == "delta", F.col("length")).otherwise(0)
    # within a gop as well by blocks: a movie may be one gop
    rows = blocks.running_sum(rows, ["movie", "gop"], "frame", size, "within").withColumn("size", size)
    gops = rows.groupBy("movie", "gop").agg(_padded(F.sum("size")).alias("pages"))
    gops = blocks.running_sum(gops, ["movie"], "gop", "pages", "start").select("movie", "gop", "start")
    counts = frames.groupBy("movie").agg(F.count("*").alias("num_frames"))
    rows = rows.join(gops, ["movie", "gop"]).join(counts, "movie")
    first = _padded(F.col("num_frames") * ENTRY_V3.size + HEADER.size)
    entry = F.struct((first + F.col("start") + F.col("within")).alias("offset"), "length", F.when(F.col("frame_class") == "key", KEY).otherwise(0).alias("flags"))
    rows = rows.withColumn("entry", F.when(F.col("frame_class") != "nop", entry))
    rows = blocks.carried(rows, ["movie"], "frame", "entry", "at")
    nop = F.col("frame_class") == "nop"
    checked = F.when(F.col("at").isNull(), F.raise_error(F.lit("the first frame can't be a nop")).cast("long")).otherwise(F.col("at.offset"))
    length = F.when(F.col("at.length") > MAX_LENGTH_V3, F.raise_error(F.lit("a frame is too long for the index")).cast("long")).otherwise(F.col("at.length"))
    end = F.when(nop, 0).otherwise(F.col("at.offset") + F.col("size"))
    flags = F.col("at.flags") + F.when(nop, NOP).otherwise(0)
    return rows.select("movie", "frame", "frame_class", checked.alias("offset"), length.alias("length"), flags.cast("int").alias("flags"), F.when(nop, 0).otherwise(F.col("adler")).alias("adler"), end.cast("long").alias("end"), "num_frames")


def pack_header(width: int, height: int, bpp: int, duration: float, num_frames: int, all_keyframes: bool, magic: int = MAGIC, version: int = 3) -> bytes:
    return HEADER.pack(magic, width, height, bpp, duration, num_frames, version | (ALL_KEYFRAMES if all_keyframes else 0) << 8)


def pack_entry(offset: int, length: int, flags: int, adler: int, version: int = 3) -> bytes:
    if not fits(length, version):
        raise ValueError(f"a frame of {length} bytes is too long for version {version}")
    return ENTRY_V3.pack(offset, length, flags, adler, 0) if version == 3 else ENTRY_V2.pack(offset, length << 8 | flags, adler)


def write_movies(encoded: DataFrame, folder: str, width: int, height: int, bpp: int, duration: float) -> None:
    """Write each movie of encoded frames to folder/movie, a POSIX folder that all executors share.

    Three steps: the layout is made and kept in the folder as a table; tasks
    write payloads by range, each its own frames, into a file of another name,
    so a movie may be of any size; then one task a movie writes index and
    header, the magic last, and renames the file. A task that runs again
    writes the same bytes at the same places, and no reader sees a partial file.
    """
    import shutil
    import uuid

    spark, work = encoded.sparkSession, os.path.join(folder, f"_work-{uuid.uuid4().hex}")
    encoded.write.parquet(f"{work}/frames")
    frames = spark.read.parquet(f"{work}/frames")
    narrow = frames.select("movie", "frame", "frame_class", F.octet_length("data").cast("long").alias("length"), "adler")
    layout(narrow).write.parquet(f"{work}/index")
    index = spark.read.parquet(f"{work}/index")
    short = index.where("num_frames < 2").select("movie").first()
    if short:
        raise ValueError(f"{short.movie}: a movie has two frames at least")

    def part(movie: str) -> str:
        return os.path.join(work, f"{movie}.part")

    def put(rows):
        for r in rows:
            with open(os.open(part(r.movie), os.O_CREAT | os.O_WRONLY), "wb") as f:
                f.seek(r.offset)
                f.write(r.data)

    frames.select("movie", "frame", "data").join(index.where("frame_class <> 'nop'").select("movie", "frame", "offset"), ["movie", "frame"]).foreachPartition(put)
    whole = index.groupBy("movie").agg(F.max("end").alias("size"), F.bool_and(F.col("frame_class") != "delta").alias("all_key"))

    def finish(rows):
        from itertools import groupby

        for movie, group in groupby(rows, key=lambda r: r.movie):
            with open(part(movie), "r+b") as f:
                for i, r in enumerate(group):
                    if i == 0:
                        f.truncate(r.size)
                        f.write(pack_header(width, height, bpp, duration, r.num_frames, r.all_key, 0))
                    f.write(pack_entry(r.offset, r.length, r.flags, r.adler))
                f.seek(0)
                f.write(struct.pack("<I", MAGIC))
                f.flush()
                os.fsync(f.fileno())
            os.replace(part(movie), os.path.join(folder, movie))

    index.join(whole, "movie").repartition("movie").sortWithinPartitions("movie", "frame").foreachPartition(finish)
    shutil.rmtree(work, ignore_errors=True)


def packed_pixels(decoded: DataFrame, width: int, height: int) -> DataFrame:
    """movie, frame, data: the dump of a frame's pixels after its width and height, two or four bytes a pixel."""
    head = bytearray(struct.pack("<II", width, height))
    return decoded.select("movie", "frame", F.concat(F.lit(head), "data").alias("data"))


def packed_codes(frame_data: DataFrame) -> DataFrame:
    """movie, frame, data: the dump of a frame's payload after width, height and whether it is a delta; empty for a nop."""

    def run(batches):
        for b in batches:
            data = [b"" if r.is_nop else struct.pack("<III", r.width, r.height, int(not r.is_key)) + bytes(r.data) for r in b.itertuples()]
            yield pd.DataFrame({"movie": b["movie"], "frame": b["frame"], "data": data})

    return frame_data.mapInPandas(run, "movie string, frame int, data binary")


def upgrade_movies(spark: SparkSession, path: str, folder: str) -> None:
    """Files of version 0 or 1 at path, decoded and written again to folder as version 3: frame 0 a keyframe, others
    key, delta or nop as their pixels say. Files of one size, depth and rate are written together."""
    heads = read_movies(spark, path, upgrade=True)
    newer = heads.where("version > 1").first()
    if newer:
        raise ValueError(f"{newer.movie}: version {newer.version} needs no upgrade")
    shapes = heads.groupBy("width", "height", "bpp", "frame_duration").agg(F.count("*").alias("n")).collect()
    whole = decode_files(spark, path, verify=False, upgrade=True)
    for s in shapes:
        same = heads.where((F.col("width") == s.width) & (F.col("height") == s.height) & (F.col("bpp") == s.bpp) & (F.col("frame_duration") == s.frame_duration)).select("movie")
        write_movies(encode_frames(whole.join(same, "movie", "left_semi"), s.bpp), folder, s.width, s.height, s.bpp, s.frame_duration)


#: Bytes of a file that one partition of the data source reads.
PART_BYTES = 64 << 20


class _Part(InputPartition):
    def __init__(self, path: str, first: int = 0, stop: int = 1 << 62):
        self.path, self.first, self.stop = path, first, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.pattern, self.step = options.get("table", "frames"), options["path"], int(options.get("bytesPerPartition", PART_BYTES))

    def partitions(self):
        """Files as they are listed, parted by size: no file is opened here."""
        from pyarrow import fs

        system, at = (fs.LocalFileSystem(), re.sub("^file:/+", "/", self.pattern)) if self.pattern.startswith(("/", "file:")) else fs.FileSystem.from_uri(self.pattern)
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        scheme = "" if isinstance(system, fs.LocalFileSystem) else self.pattern.split("://")[0] + "://"
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))
        if self.table != "frame_data":
            return [_Part(scheme + p) for p, _ in files]
        return [_Part(scheme + p, a, a + self.step) for p, size in files for a in range(0, max(size, 1), self.step)]

    def read(self, part: _Part):
        """With payloads, the frames whose offset lies in the part's range of bytes."""
        movie = os.path.basename(part.path)
        with open_file(part.path) as f:
            head = _head(f)
            if self.table == "movies":
                yield (movie, *head.values())
                return
            for e in entries_of(f, head):
                e.pop("gop")
                if not part.first <= e["offset"] < part.stop:
                    continue
                row = (movie, *e.values())
                if self.table == "frame_data":
                    row += (head["width"], head["height"], head["bpp"], b"" if e["is_nop"] else read_at(f, e["offset"], e["length"], f"frame {e['frame']} of {movie}"))
                yield row


class AnimationSource(DataSource):
    """spark.dataSource.register(AnimationSource); spark.read.format("animation").option("table", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "animation"

    def schema(self) -> str:
        return {"movies": MOVIES, "frames": FRAMES, "frame_data": FRAME_DATA}[self.options.get("table", "frames")]

    def reader(self, schema):
        return _Reader(dict(self.options))
