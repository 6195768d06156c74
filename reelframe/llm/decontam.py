"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import released

WINDOW = 13
#: Bytes of benchmark text that one automaton may hold, and of texts that a task keeps while it goes through
#: the automata of a benchmark that needs several.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 64 << 20

#: UTF-8 bytes of a word are 0-9, a-z and all of 0x80 and above; A-Z are lower-cased, others part words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text. After the fold only 0x20 parts them, which bytes.split does."""
    return data.translate(_FOLD).split() if data else []


class Scanner:
    """An automaton over word numbers: a node is a word, so a hit's place is a word index.

    An item shorter than a window is a key itself. Of a longer one the keys are
    its aligned seeds, runs of half a window's words that begin at every
    multiple of their length: each window holds one of them whole. So the
    automaton has about one node a word, not one for each word of each window.
    Where a seed is found, the words about it decide exactly which windows of
    the item are there. Seeds that stand in equal surroundings are one entry.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        self.size, self.seed = size, (size + 1) // 2
        self.reach = size - self.seed  # words on either side that a window about a seed can have
        self.ids: dict[bytes, int] = {}
        whole: dict[tuple[int, ...], set[str]] = {}
        about: dict[tuple[int, ...], dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            item = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            if len(item) < size:
                if item:
                    whole.setdefault(tuple(item), set()).add(name)
                continue
            padded = [-1] * self.reach + item + [-1] * self.reach
            for i in range(0, len(item) - self.seed + 1, self.seed):
                around = (*padded[i : i + self.reach], *padded[i + self.reach + self.seed : i + size + self.reach])
                about.setdefault(tuple(item[i : i + self.seed]), {}).setdefault(around, set()).add(name)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in whole.keys() | about.keys():
            around = about.get(key)
            table = (np.array(list(around), np.int64).reshape(len(around), -1), [frozenset(x) for x in around.values()]) if around else None
            self.auto.add_word(key, (len(key), frozenset(whole.get(key, ())), table))
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word ranges that windows cover, names of the items)."""
        if self.empty or not text:
            return [], set()
        get, ranges, names, padded = self.ids.get, [], set(), None
        numbers = tuple([get(w, 0) for w in text])
        for end, (n, who, table) in self.auto.iter(numbers):
            at = end - n + 1
            if who:
                names |= who
                ranges.append((at, end + 1))
            if table:
                if padded is None:
                    padded = np.array((0,) * self.reach + numbers + (0,) * self.reach, np.int64)
                r = self.reach
                left = np.cumprod(table[0][:, :r][:, ::-1] == padded[at : at + r][::-1], axis=1).sum(1)
                right = np.cumprod(table[0][:, r:] == padded[at + r + n : at + r + n + r], axis=1).sum(1)
                for k in np.flatnonzero(left + right >= r).tolist():
                    names |= table[1][k]
                    ranges.append((at - int(left[k]), end + 1 + int(right[k])))
        return merged(ranges), names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point spans of the original text, first word's start to last word's end."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in ranges]


_SCHEMA = "n_words long, ranges array<struct<lo:long,hi:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcasts of the items that have an id and a text, each of about block_bytes of text or one item."""
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("id"), "text")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = []
    for i in range(blocks):
        part = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i) if blocks > 1 else known
        out.append(known.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in part.toLocalIterator()]))
    return out


def _scans(batches, column: int, handed: list, size: int):
    """(batch, [(words, ranges, names) of each row]) of each Arrow batch.

    With one block of items a text is scanned as it comes. With more, a task
    keeps up to HELD_BYTES of texts and takes them through one automaton after
    the other, so that it holds one automaton at a time and reads a text once.
    """
    one = Scanner(handed[0].value, size) if len(handed) == 1 else None
    held, weight = [], 0

    def texts(batch):
        for t in batch.column(column):
            yield b.to_pybytes() if (b := t.as_buffer()) is not None else None

    def flush():
        found = [[(len(words(t)), [], set()) for t in texts(batch)] for batch in held]
        for block in handed:
            scanner = Scanner(block.value, size)
            for batch, rows in zip(held, found):
                for k, t in enumerate(texts(batch)):
                    ranges, names = scanner.scan(words(t))
                    if ranges:
                        rows[k] = (rows[k][0], merged(rows[k][1] + ranges), rows[k][2] | names)
        yield from zip(held, found)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # slices bound what a batch of long texts adds at once
            part = batch.slice(lo, 256)
            if one:
                yield part, [(len(w), *one.scan(w)) for w in map(words, texts(part))]
                continue
            held.append(part)
            weight += part.nbytes
            if weight >= HELD_BYTES:
                yield from flush()
                held, weight = [], 0
    if held:
        yield from flush()


_SCHEMA = "n_words long, ranges array<struct<lo:long,hi:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: key, n_words, ranges (merged word ranges that windows of items
    cover), items (their ids as sorted strings), spans (the ranges as code-point offsets of the
    original text).

    One pass over the texts without a shuffle, whatever the benchmark's size; a
    benchmark beyond block_bytes is scanned by several automata in turn, see
    _scans. Null or empty text: no words, no hits. Items with a null id or
    without words are never found; items that repeat count once. Rows that
    repeat come out each, an empty table gives no rows. Other columns of either
    table are ignored; an empty benchmark finds nothing.
    """
    handed = _blocks(benchmark, block_bytes)
    schema = docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, {_SCHEMA}").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch, found in _scans(batches, 1, handed, size):
            spans = [char_spans(t.as_py(), ranges) if ranges else [] for t, (_, ranges, _) in zip(batch.column(1), found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(arrow.field(0).type),
                    pa.array([n for n, _, _ in found], arrow.field(1).type),
                    pa.array([[{"lo": lo, "hi": hi} for lo, hi in ranges] for _, ranges, _ in found], arrow.field(2).type),
                    pa.array([sorted(names) for _, _, names in found], arrow.field(3).type),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], arrow.field(4).type),
                ],
                schema=arrow,
            )

    return docs.select(key, "text").mapInArrow(released(run), schema)


def n_hit(ranges="ranges"):
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = n_hit()
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated, in one pass without a shuffle. Null and empty texts
    stay, a null doc_id is judged by its text, rows that repeat are judged each; empty tables are fine."""
    handed, at = _blocks(benchmark, block_bytes), docs.columns.index("text")

    def run(batches):
        for batch, found in _scans(batches, at, handed, size):
            hits = [(n, sum(hi - lo for lo, hi in ranges)) for n, ranges, _ in found]
            yield batch.filter(pa.array([not (hit and 20 * hit >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
