"""Pictures: a small PNG codec, image sequences, flat pictures and sinks.

sRGB and untagged pictures are taken as they are; colour profiles are not applied.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from . import codec

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _raw_rows(px: np.ndarray, width: int, height: int, bpp: int) -> bytes:
    """Unfiltered rows of pixel words; at 32 bits premultiplied words are written with plain colours."""
    px = px.astype(np.uint32)
    if bpp == 16:
        parts = [(px >> s & 31) * 255 // 31 for s in (10, 5, 0)]
    else:
        parts = [px >> s & 255 for s in (16, 8, 0)]
    if bpp == 32:
        a = px >> 24
        parts = [_unpremultiplied(c, a) for c in parts] + [a]
    rows = np.stack(parts, 1).astype(np.uint8).reshape(height, -1)
    return np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()


def png(px: np.ndarray, width: int, height: int, bpp: int) -> bytes:
    """A picture of pixel words."""
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if bpp == 32 else 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(_raw_rows(px, width, height, bpp), 6)) + _chunk(b"IEND", b"")


def _unpremultiplied(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    c, a = c.astype(np.int64), a.astype(np.int64)
    u = np.minimum(c * 255 // np.maximum(a, 1), 255)
    back = u * a // 255
    u = np.where(back < c, np.minimum(u + 1, 255), np.where(back > c, np.maximum(u - 1, 0), u))
    return np.where(a == 0, 0, u)


#: First column and row, and steps, of the passes of an interlaced picture.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


class Picture:
    """The chunks of a PNG file."""

    def __init__(self, data: bytes):
        if data[:8] != _SIGNATURE:
            raise ValueError("not a PNG file")
        at, self.body, self.palette, self.clear, head = 8, [], None, None, None
        while at + 8 <= len(data):
            (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
            part = data[at + 8 : at + 8 + n]
            if len(part) < n:
                raise ValueError("the PNG file is cut short")
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                self.palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                self.clear = part
            elif kind == b"IDAT":
                self.body.append(part)
            at += 12 + n
        self.width, self.height, self.depth, self.colour, _, _, self.interlaced = head
        if self.depth not in _DEPTHS.get(self.colour, ()):
            raise ValueError(f"no PNG file has depth {self.depth} with colour type {self.colour}")
        self.bits = _CHANNELS[self.colour] * self.depth
        self.step = max(1, self.bits // 8)

    def stride(self, width: int) -> int:
        return (width * self.bits + 7) // 8

    def words(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Premultiplied words 0xAARRGGBB of unfiltered rows. Samples of 16 bits count by their high byte, those
        of fewer than 8 are spread over 0 to 255."""
        channels = _CHANNELS[self.colour]
        if self.depth == 16:
            full = rows.reshape(len(rows), -1, 2).astype(np.uint32)
            v = (full[:, :, 0] << 8 | full[:, :, 1])[:, : width * channels].reshape(-1, channels)
        elif self.depth == 8:
            v = rows[:, : width * channels].reshape(-1, channels).astype(np.uint32)
        else:
            bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, self.depth)
            v = (bits @ (1 << np.arange(self.depth)[::-1])).astype(np.uint32)[:, :width].reshape(-1, 1)
        a = np.full(len(v), 255, np.uint32)
        if self.colour == 3:
            if self.palette is None or v.max(initial=0) >= len(self.palette):
                raise ValueError("a colour isn't in the palette")
            if self.clear:
                table = np.full(max(len(self.palette), len(self.clear)), 255, np.uint32)
                table[: len(self.clear)] = np.frombuffer(self.clear, np.uint8)
                a = table[v[:, 0]]
            v = self.palette[v[:, 0]].astype(np.uint32)
        else:
            if self.clear and self.colour in (0, 2):
                key = np.array(struct.unpack(f">{channels}H", self.clear), np.uint32)
                a = np.where((v == key).all(1), 0, 255).astype(np.uint32)
            v = v >> 8 if self.depth == 16 else v * 255 // ((1 << self.depth) - 1)
            if self.colour in (4, 6):
                a = v[:, -1]
        r, g, b = (v[:, 0],) * 3 if self.colour in (0, 4) else (v[:, 0], v[:, 1], v[:, 2])
        r, g, b = (c * a // 255 for c in (r, g, b))
        return a << 24 | r << 16 | g << 8 | b

    def bands(self, height: int):
        """Words of `height` rows after another; one band is in memory at a time. Not for interlaced pictures."""
        unpack, stride, raw = zlib.decompressobj(), self.stride(self.width) + 1, bytearray()
        up = np.zeros(stride - 1, np.uint8)
        for part in self.body:
            while part:
                raw += unpack.decompress(part, max(height * stride - len(raw), 1))
                part = unpack.unconsumed_tail
                while len(raw) >= height * stride:
                    lines = np.frombuffer(bytes(raw[: height * stride]), np.uint8).reshape(height, stride)
                    del raw[: height * stride]
                    rows = unfilter(lines, up, self.step)
                    up = rows[-1]
                    yield self.words(rows, self.width)
        raw += unpack.flush()
        if raw:
            lines = np.frombuffer(bytes(raw), np.uint8)
            rows = unfilter(lines[: len(lines) // stride * stride].reshape(-1, stride), up, self.step)
            if len(rows):
                yield self.words(rows, self.width)

    def all_words(self) -> np.ndarray:
        if not self.interlaced:
            got = np.concatenate([*self.bands(self.height), np.empty(0, np.uint32)])
        else:
            raw, at = np.frombuffer(zlib.decompress(b"".join(self.body)), np.uint8), 0
            whole = np.zeros((self.height, self.width), np.uint32)
            for x, y, dx, dy in _PASSES:
                w, h = -(-(self.width - x) // dx), -(-(self.height - y) // dy)
                if w > 0 and h > 0:
                    stride = self.stride(w) + 1
                    lines = raw[at : at + h * stride].reshape(h, stride)
                    at += h * stride
                    whole[y::dy, x::dx] = self.words(unfilter(lines, np.zeros(stride - 1, np.uint8), self.step), w).reshape(h, w)
            got = whole.reshape(-1)
        if len(got) != self.width * self.height:
            raise ValueError("the PNG file has too few rows")
        return got


def read_png(data: bytes) -> tuple[np.ndarray, int, int]:
    """(words 0xAARRGGBB, premultiplied; width; height)."""
    picture = Picture(data)
    return picture.all_words(), picture.width, picture.height


def unfilter(lines: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filter byte and filter. up: the row above; step: bytes of a pixel.

    Rows whose filters look at one neighbour are sums of whole rows. Where an
    average or a Paeth filter occurs, a value needs those left, above and above
    left: then all places with the same sum of row and column are done at once.
    """
    kinds, height, width = lines[:, 0], len(lines), lines.shape[1] - 1
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if not (kinds > 2).any():
        out = np.empty((height, width), np.uint8)
        for y in range(height):
            row = lines[y, 1:]
            if kinds[y] == 1:
                cut = width - width % step
                row = np.concatenate([np.cumsum(row[:cut].reshape(-1, step), 0, dtype=np.uint8).reshape(-1), row[cut:]])
            out[y] = up = row + up if kinds[y] == 2 else row
        return out
    pixels = width // step
    got = np.zeros((height + 1, pixels + 1, step), np.int64)
    got[0, 1:] = up.reshape(pixels, step)
    raw = lines[:, 1:].reshape(height, pixels, step).astype(np.int64)
    for t in range(pixels + height - 1):
        y = np.arange(max(0, t - pixels + 1), min(height, t + 1))
        x, kind = t - y, kinds[y][:, None]
        a, b, c = got[y + 1, x], got[y, x + 1], got[y, x]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        got[y + 1, x + 1] = raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, paeth], 0) & 255
    return got[1:, 1:].reshape(height, width).astype(np.uint8)


def sequence_of(spark: SparkSession, first: str) -> DataFrame:
    """frame, content of the numbered files from `first` on, up to the first number that is missing.

    Numbers are zero-padded as the first one's; those that need more digits have
    them, as write_pictures names them, up to any number. The end of the sequence
    is the least number whose successor is missing, so no window is needed. Fewer
    than two files are an error.
    """
    folder, name = os.path.split(first)
    found = re.match(r"(.*?)(\d+)(\.[^.]+)$", name)
    if not found:
        raise ValueError("the first file's name must end in a number")
    prefix, digits, ext = found.groups()
    pattern = f"^{re.escape(prefix)}(\\d{{{len(digits)}}}|[1-9]\\d{{{len(digits)},}}){re.escape(ext)}$"
    files = spark.read.format("binaryFile").load(folder).withColumn("n", F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1).try_cast("long"))
    files = files.where(F.col("n") >= int(digits))
    numbers = files.select("n")
    ends = numbers.join(numbers.select((F.col("n") - 1).alias("n")), "n", "left_anti")
    end = ends.agg(F.min("n").alias("end"))
    few = F.raise_error(F.lit("an image sequence needs two files at least")).cast("long")
    last = end.select(F.when(F.col("end") > int(digits), F.col("end")).otherwise(few).alias("end")).scalar()
    return files.where(F.col("n") <= last).select((F.col("n") - int(digits)).cast("int").alias("frame"), "content")


def decode_pictures(pictures: DataFrame) -> DataFrame:
    """frame, width, height, data (32-bit words) of PNG contents."""

    def run(batches):
        for b in batches:
            got = [read_png(c) for c in b["content"]]
            yield pd.DataFrame({"frame": b["frame"], "width": [w for _, w, _ in got], "height": [h for _, _, h in got], "data": [p.astype("<u4").tobytes() for p, _, _ in got]})

    return pictures.mapInPandas(run, "frame int, width int, height int, data binary")


def _png_file(part: str, name: str, chunks) -> None:
    with open(part, "wb") as f:
        f.writelines(chunks)
    os.replace(part, name)


def write_pictures(decoded: DataFrame, folder: str, width: int, height: int, prefix: str = "Frame") -> None:
    """PREFIX0001.png and on, numbered from 1, duplicates too, in a folder that all executors share."""

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            px = np.frombuffer(bytes(r.data), codec.pixel_type(r.bpp))
            _png_file(os.path.join(folder, f".{prefix}{r.frame}.{os.getpid()}"), os.path.join(folder, f"{prefix}{r.frame + 1:04d}.png"), [png(px, width, height, r.bpp)])

    decoded.select("frame", "bpp", "data").foreachPartition(put)


def write_flat(decoded: DataFrame, folder: str, width: int, height: int, bpp: int, num_frames: int) -> None:
    """One picture a movie, folder/movie.png, with all frames under one another. A task writes a movie frame by
    frame and holds one frame. 16 bits aren't supported; a movie with another number of frames is an error."""
    if bpp == 16:
        raise ValueError("16 bits aren't supported")

    def chunks(rows):
        yield _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height * num_frames, 8, 6 if bpp == 32 else 2, 0, 0, 0))
        pack, n = zlib.compressobj(6), 0
        for r in rows:
            n += 1
            px = np.frombuffer(bytes(r.data), "<u4")
            if r.frame != n - 1 or len(px) != width * height:
                raise ValueError(f"frame {r.frame} of {r.movie} isn't the next one, or of another size")
            yield _chunk(b"IDAT", pack.compress(_raw_rows(px, width, height, bpp)))
        if n != num_frames:
            raise ValueError(f"{n} frames where {num_frames} are expected")
        yield _chunk(b"IDAT", pack.flush()) + _chunk(b"IEND", b"")

    def put(rows):
        from itertools import groupby

        os.makedirs(folder, exist_ok=True)
        for movie, group in groupby(rows, key=lambda r: r.movie):
            _png_file(os.path.join(folder, f".{movie}.{os.getpid()}"), os.path.join(folder, f"{movie}.png"), chunks(group))

    decoded.select("movie", "frame", "data").repartition("movie").sortWithinPartitions("movie", "frame").foreachPartition(put)


def read_flat(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """movie, frame, data (premultiplied 32-bit words) of flat pictures. A picture must be as wide as the movie and
    a whole number of frames high. A task holds a file and one frame."""

    def run(batches):
        for b in batches:
            for at, content in zip(b["path"], b["content"]):
                picture = Picture(content)
                if picture.width != width or picture.height % height or not picture.height:
                    raise ValueError(f"{picture.width} x {picture.height} isn't made of frames of {width} x {height}")
                movie = os.path.basename(at).removesuffix(".png")
                whole = [picture.all_words()[i : i + width * height] for i in range(0, width * picture.height, width * height)] if picture.interlaced else picture.bands(height)
                for frame, px in enumerate(whole):
                    yield pd.DataFrame({"movie": [movie], "frame": [frame], "data": [px.astype("<u4").tobytes()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "movie string, frame bigint, data binary")


def text_dump(pixels: DataFrame, width: int, bpp: int) -> DataFrame:
    """frame, row, column and the text of each pixel, to be ordered by these at the sink."""
    px = F.col("px")
    parts = [P.red(px, bpp), P.green(px, bpp), P.blue(px, bpp)] + ([P.alpha(px)] if bpp == 32 else [])
    text = F.concat(P.hex_word(px, bpp), F.lit(" ("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")"))
    return pixels.select("frame", P.div(F.col("idx"), width).alias("row"), F.pmod("idx", F.lit(width)).alias("column"), text.alias("text"))


def text_lines(pixels: DataFrame, frames: DataFrame, name: str, width: int, bpp: int) -> DataFrame:
    """frame, idx, part, text: the lines of the pixel report, in that order.

    frames: frame, is_duplicate. The first line tells the file; each frame has a
    line, a duplicate nothing else; then each row and each pixel has one.
    """
    none = F.lit(-1).cast("long")
    count = frames.agg(F.count("*").alias("n"))
    file = count.select(none.alias("frame"), none.alias("idx"), F.lit(0).alias("part"), F.concat(F.lit(f"File {name}, {bpp}BPP, "), F.col("n").cast("string"), F.lit(" FRAMES")).alias("text"))
    title = F.concat(F.lit("FRAME "), (F.col("frame") + 1).cast("string"), F.when(F.col("is_duplicate"), " (duplicate)").otherwise(""))
    heads = frames.select(F.col("frame").cast("long").alias("frame"), none.alias("idx"), F.lit(0).alias("part"), title.alias("text"))
    shown = pixels.join(frames.where("not is_duplicate").select("frame"), "frame", "left_semi")
    px, row, column = F.col("px"), P.div(F.col("idx"), width), F.pmod("idx", F.lit(width))
    parts = [P.red(px, bpp), P.green(px, bpp), P.blue(px, bpp)] + ([P.alpha(px)] if bpp == 32 else [])
    values = F.concat_ws(", ", *[p.cast("string") for p in parts])
    pixel = F.concat(F.lit("COLUMN "), column.cast("string"), F.lit(": HEX 0x"), P.hex_word(px, bpp), F.lit(", RGBA = (" if bpp == 32 else ", RGB = ("), values, F.lit(")"))
    lines = F.array(F.struct(F.lit(0).alias("part"), F.when(column == 0, F.concat(F.lit("ROW "), row.cast("string"))).alias("text")), F.struct(F.lit(1).alias("part"), pixel.alias("text")))
    body = shown.select("frame", "idx", F.explode(F.filter(lines, lambda x: x["text"].isNotNull())).alias("x")).select("frame", "idx", "x.part", "x.text")
    return file.union(heads).union(body)


def in_order(lines: DataFrame) -> DataFrame:
    """Lines as a sink writes them: by frame, then place, then part. A range sort, not one task."""
    return lines.orderBy("frame", "idx", "part")
