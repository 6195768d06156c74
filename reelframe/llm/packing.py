"""Hierarchical multi-length packing of token documents into windows of power-of-two sizes."""

from __future__ import annotations

import bisect
import heapq
import json
import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import released

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that a task holds before it packs them, and tokens of a step group.
POOL_TOKENS, STEP_TOKENS = 1 << 20, 1 << 18
#: Distinct chunks whose ids a Python worker remembers, and bytes of text that it splits at once.
CACHE, SLICE_BYTES = 400_000, 8 << 20

#: Chunks of printable ASCII without an apostrophe and of Latin-1 letters, and the pieces that the pre-tokenizer makes of them.
_SIMPLE = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-`{-~]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The normaliser and pre-tokenizer that the chunks follow, as the tokenizer's file states them.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, by way of the distinct chunks of a slice of texts.

    A pre-tokenizer as in CHUNKED never joins characters across a space, tab or
    line feed, so a text's ids are those of its chunks one after another. A new
    chunk of simple characters goes to the tokenizer's model piece by piece; any
    other chunk goes through the whole tokenizer. With any other tokenizer file
    every text goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model, self.alphabet = self.tokenizer.model, _byte_characters()
        stated = json.loads(self.tokenizer.to_str())
        special = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in stated["added_tokens"])
        self.chunked = special and all(stated[k] == v for k, v in CHUNKED.items()) and stated["truncation"] is None

    def chunk(self, c: bytes) -> bytes:
        """The ids of a chunk; c is the key under which they are remembered."""
        if _SIMPLE.fullmatch(c):
            model, alphabet = self.model.tokenize, self.alphabet
            ids = [t.id for p in _PIECE.findall(c.decode().lower().encode()) for t in model(p.decode("latin-1").translate(alphabet))]
        else:
            ids = self.tokenizer.encode(c.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def lookup(self, c: bytes) -> bytes:
        got = self.known.get(c)
        if got is None:
            if c[-1:] in (b".", b",") and len(c) > 1 and (97 <= c[-2] <= 122):  # a stop after a letter is a piece of its own
                got = self.lookup(c[:-1]) + self.lookup(c[-1:])
            else:
                got = self.known[c] = self.chunk(c) if c else b""
        return got

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, without the end id; null is empty. Texts come as an Arrow string array."""
        if not self.chunked:
            return [np.asarray(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        if len(self.known) > CACHE:
            self.known.clear()
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):  # control strings are ids of their own only as they are written
            out[i] = np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
        plain = pc.fill_null(pc.if_else(special, pa.scalar("", texts.type), texts), "")
        for sign in ("\n", "\t"):
            plain = pc.replace_substring(plain, sign, " ")
        split = pc.split_pattern(pc.ascii_lower(plain), " ")
        flat = pc.dictionary_encode(split.flatten())
        each = [self.lookup(c) for c in flat.dictionary.cast(pa.binary()).to_pylist()]
        sizes = np.fromiter((len(x) for x in each), np.int64, len(each)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data, which = np.frombuffer(b"".join(each), "<u4"), flat.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = data[np.arange(total) + np.repeat(starts[which] - (ends - n), n)]
        words = np.asarray(split.offsets)
        words = words - words[0]
        cuts = np.concatenate([[0], ends])[words]
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                out[i] = ids[a:b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs documents in the order they come; holds at most pool_tokens and one document.

    Routing: whole windows of the largest tier are cut from a long document and
    its rest goes to the smallest tier that holds it. Tiers are packed from the
    longest down. Each document of a tier that no longer window has taken opens
    a window of its tier; the gap takes the longest fitting documents of the
    shorter tiers, and when none fits, a piece cut from the longest one left, so
    that only the last windows of a pool can end short. What is left of those is
    cut to powers of two, which are not padded.

    A pool's sequences are dealt to step groups, the longest first and each to
    the group with fewest tokens, so a group has its share of each tier.
    """

    def __init__(self, tiers=TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.most, self.pool_tokens, self.step_tokens = sorted(tiers), max(tiers), pool_tokens, step_tokens
        self.pool: list[list[tuple]] = [[] for _ in self.tiers]
        self.whole: list[list[tuple]] = []  # finished windows of the largest tier
        self.held = self.groups = 0

    def add(self, doc, ids: np.ndarray):
        """doc: any label. Yields (sequence, its step group); a sequence is a list of (doc, start, ids)."""
        start, n = 0, len(ids)
        while n - start >= self.most:
            self.whole.append([(doc, start, ids[start : start + self.most])])
            start += self.most
        if start < n:
            self.pool[bisect.bisect_left(self.tiers, n - start)].append((doc, start, ids[start:]))
        self.held += n
        if self.held >= self.pool_tokens:
            yield from self.flush()

    def flush(self):
        sequences = self.whole + list(self._windows())
        lengths = [sum(len(p[2]) for p in s) for s in sequences]
        count = max(1, round(sum(lengths) / self.step_tokens))
        load = [(0, self.groups + g) for g in range(count)]
        group = [0] * len(sequences)
        for k in sorted(range(len(sequences)), key=lambda k: -lengths[k]):
            tokens, g = load[0]
            heapq.heapreplace(load, (tokens + lengths[k], g))
            group[k] = g
        self.groups += count
        self.whole, self.held = [], 0
        yield from zip(sequences, group)

    def _windows(self):
        free: list[tuple[int, int]] = []  # (length, number), sorted: the documents of the tiers below
        pieces: dict[int, tuple] = {}
        number = 0

        def give(piece):
            nonlocal number
            pieces[number] = piece
            bisect.insort(free, (len(piece[2]), number))
            number += 1

        pool, self.pool = self.pool, [[] for _ in self.tiers]
        for docs in pool:
            for d in docs:
                give(d)
        left: list[list] = []
        for tier, floor in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while free and free[-1][0] > floor:
                d = pieces.pop(free.pop()[1])  # the longest left: its tier's own
                window, room = [d], tier - len(d[2])
                while room and free:
                    below = bisect.bisect_right(free, (floor, number)) if floor else len(free)  # documents of shorter tiers; in the last tier all
                    if not below:
                        break
                    k = bisect.bisect_right(free, (room, number), hi=below) - 1
                    length, which = free.pop(k if k >= 0 else below - 1)
                    doc, start, ids = pieces.pop(which)
                    if length > room:
                        give((doc, start + room, ids[room:]))
                        ids = ids[:room]
                    window.append((doc, start, ids))
                    room -= len(ids)
                if room:
                    left.append(window)
                else:
                    yield window
        # the windows that no shorter document could fill: one run, cut to powers of two
        run = deque(p for w in left for p in w)
        total = sum(len(p[2]) for p in run)
        while total:
            size = min(self.most, 1 << (total.bit_length() - 1))
            window, room = [], size
            while room:
                doc, start, ids = run.popleft()
                if len(ids) > room:
                    run.appendleft((doc, start + room, ids[room:]))
                    ids = ids[:room]
                window.append((doc, start, ids))
                room -= len(ids)
            total -= size
            yield window


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def pack(docs: DataFrame, tokenizer: str | None = None, tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length and step_group, with_ids also ids (binary, little-endian unsigned 32-bit).

    No shuffle: each task packs the rows of its partition, with one pool of
    tokens in memory. sequence_id is the task's partition number and a count,
    so a task that runs again gives the same rows. step_group: the sequences of
    a pool make about one group for each step_tokens of it, dealt so that their
    tokens differ by less than the largest tier; see Packer. Null text is empty:
    one piece with the end id. A null doc_id stays null. Rows that repeat are
    packed each. An empty table gives no rows. Other columns are ignored.
    """
    path, many = tokenizer or default_tokenizer(), tuple(tiers)

    def task():
        encoder, packer = encoder_of(path), Packer(many, step_tokens=step_tokens)
        base = TaskContext.get().partitionId() << 36
        state = {"sequence": base}

        def rows(sequences, out):
            for pieces, group in sequences:
                length, offset = sum(len(p[2]) for p in pieces), 0
                for (doc, total), start, ids in pieces:
                    data = ids.tobytes()
                    for column, x in zip(out.values(), (doc, start, len(ids), zlib.crc32(data), total, state["sequence"], offset, length, base + group, data)):
                        column.append(x)
                    offset += len(ids)
                state["sequence"] += 1

        return encoder, packer, rows

    names = [*(x.split()[0] for x in SCHEMA.split(", ")), "ids"]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], SCHEMA + (", ids binary" if with_ids else "")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoder, packer, rows = task()
        out = {n: [] for n in names}

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            for x in out.values():
                x.clear()
            return got

        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1))):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    rows(packer.add((doc, len(ids)), ids), out)
                    if len(out["doc_id"]) >= 4096:
                        yield batch()
        rows(packer.flush(), out)
        if out["doc_id"]:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)
