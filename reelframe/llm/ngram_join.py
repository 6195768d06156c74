"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, split_join, stream_groups, written
from .components import connected_components

SHINGLE, PERCENT = 4, 85
#: Minima of a set, and candidate keys: KEYS keys, each of CHOSEN of the minima. Two sets of similarity 0.85 share no
#: key with a chance of 7e-8, of 0.9 with 5e-13; of similarity 0.3 they share one with a chance of 4.5 %.
MINIMA, KEYS, CHOSEN = 128, 64, 6
#: Numbers of minima in which two sets differ. Linked sets differ in more than LINKED of them with a chance of 1e-8. A
#: leader covers what differs in at most COVERED; a set that is linked with that differs in at most the sum.
LINKED, COVERED = 44, 12
#: Rows of a key that are led by one leader search; shingles that a tile may hold (64 more are counted for each row);
#: bits of a signature.
LED_ROWS, TILE_SHINGLES, BITS = 8192, 1 << 21, 1024

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
_ODD = _RANDOM.integers(0, 2**31, size=(MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, size=(MINIMA, 1), dtype=np.uint32)
_PICKS = np.array([_RANDOM.choice(MINIMA, CHOSEN, replace=False) for _ in range(KEYS)])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M3, _M4 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; a shorter text is one run, an empty one none."""
    split = text.translate(_FOLD).split() if text else ()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    k = min(n, len(h))
    run = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        run = _mix(run * _M2 + h[i : len(h) - k + 1 + i])
    return np.unique(run)


def minima(s: np.ndarray) -> np.ndarray:
    """16 bits of each of MINIMA least values of a set under independent 32-bit hashes (multiply, add, rotate)."""
    folded = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(folded), 2048):  # bounded memory for very long texts
        x = _ODD * folded[None, lo : lo + 2048]
        x += _ADD
        x ^= x >> np.uint32(15)
        x *= _M3
        np.minimum(least, x.min(1), out=least)
    least = (least ^ (least >> np.uint32(16))) * _M4
    return ((least ^ (least >> np.uint32(15))) & np.uint32(0xFFFF)).astype("<u2")


def keys(least: np.ndarray) -> np.ndarray:
    """The KEYS keys of each row of minima."""
    out = np.repeat(np.arange(1, KEYS + 1, dtype=np.uint64)[None, :], len(least), axis=0)
    for j in range(CHOSEN):
        out = _mix(out * _M2 + least[:, _PICKS[:, j]].astype(np.uint64))
    return out.view(np.int64)


def lead(ids: np.ndarray, low: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(edges of rows with leaders, the leaders' places). low: the low bytes of each row's minima.

    The first row that no leader covers becomes one, until all are covered; a
    row belongs to each leader that it differs from in at most COVERED + LINKED
    minima. Differences obey the triangle inequality, so two linked rows both
    belong to the leader that covers one of them. Edges span what belongs
    together: there are fewer than rows, however many leaders there are.
    """
    edges, leaders, left, group = [], [], np.arange(len(ids)), np.arange(len(ids))
    while len(left):
        i = left[0]
        apart = (low[left] != low[i]).sum(1)
        near = left[apart <= COVERED + LINKED]
        edges += _span(ids, group, i, near)
        leaders.append(int(i))
        left = left[(apart > COVERED) & (left != i)]
    return edges, leaders


def _span(ids: np.ndarray, group: np.ndarray, i: int, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of place i with those of `near` that aren't in its group yet, one for each group; group is changed."""
    out = []
    new, first = np.unique(group[near], return_index=True)
    for g, k in zip(new, first):
        if g != group[i]:
            out.append((int(ids[i]), int(ids[near[k]])))
    group[np.isin(group, new)] = group[i]
    return out


def lead_leaders(ids: np.ndarray, low: np.ndarray, other_ids: np.ndarray | None = None, other_low: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of leaders, or of two blocks of leaders, that differ in at most 2 * COVERED + LINKED minima:
    the leaders of linked rows do."""
    if other_ids is None:
        other_ids, other_low, base = ids, low, 0
    else:
        base = len(ids)
    all_ids = ids if not base else np.concatenate([ids, other_ids])
    edges, group = [], np.arange(len(all_ids))
    for i in range(len(ids)):
        first = i + 1 if not base else 0
        near = np.flatnonzero((other_low[first:] != low[i]).sum(1) <= 2 * COVERED + LINKED) + first + base
        edges += _span(all_ids, group, i, near)
    return edges


def signature(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bitmap with the bit of each shingle set."""
    out = np.zeros(bits, np.uint8)
    out[(s % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on sorted arrays: 100 * |a & b| >= percent * |a | b|."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Overlaps:
    """Shared shingles of a row with many others: each shingle gets a number, so that a row's are marks in a table."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray]):
        _, at = np.unique(np.concatenate(left + right), return_inverse=True)
        ends = np.cumsum([len(s) for s in left + right])
        self.codes = [at[e - len(s) : e].astype(np.int32) for e, s in zip(ends, left + right)]
        self.left, self.right = self.codes[: len(left)], self.codes[len(left) :] or self.codes
        self.flat = np.concatenate(self.right)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in self.right])])
        self.mark = np.zeros(int(at.max()) + 1, np.uint8)

    def of(self, i: int, with_: np.ndarray) -> np.ndarray:
        """How many shingles row i of left shares with each of these rows (ascending) of right."""
        lo, hi = int(with_[0]), int(with_[-1]) + 1
        self.mark[self.left[i]] = 1
        if 2 * len(with_) > hi - lo:
            starts = self.at[lo:hi]
            both = np.add.reduceat(self.mark[self.flat[starts[0] : self.at[hi]]], starts - starts[0], dtype=np.int64)[with_ - lo]
        else:
            starts = np.concatenate([[0], np.cumsum(self.at[with_ + 1] - self.at[with_])[:-1]])
            both = np.add.reduceat(self.mark[np.concatenate([self.right[j] for j in with_.tolist()])], starts, dtype=np.int64)
        self.mark[self.left[i]] = 0
        return both


def tile_links(left: list[tuple], right: list[tuple] | None, percent: int = PERCENT, counted: bool = True) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(a spanning set of the links, links of each row) between two tiles, or within one (right None).

    A row is (doc_id, shingles, copies); a link counts as many times as the
    partner has copies. Rows are in order of size, so a row's partners by size
    are one run. Of the run, the bitmaps bound the overlap from above: shingles
    of a whose bit b lacks are surely not in b. What passes is tested exactly;
    where links aren't counted, only if it isn't connected yet.
    """
    same, out, overlaps = right is None, [], None
    left = sorted(left, key=lambda r: (len(r[1]), r[0]))
    right = left if same else sorted(right, key=lambda r: (len(r[1]), r[0]))
    size = np.array([len(r[1]) for r in right])
    bits = np.array([signature(r[1]) for r in right])
    filled = np.bitwise_count(bits).sum(1).astype(np.int64) if len(bits) else size
    base = 0 if same else len(left)
    group = np.arange(base + len(right))  # of each row of left, then of right, the least row that links reach
    links = np.zeros(len(group), np.int64)
    copies = np.array([r[2] for r in right], np.int64)
    for i, (doc, s, own_copies) in enumerate(left):
        n = len(s)
        lo = i + 1 if same else int(np.searchsorted(size, -(-n * percent // 100)))
        hi = int(np.searchsorted(size, n * 100 // percent, side="right"))
        if lo >= hi:
            continue
        own = signature(s)
        common = np.bitwise_count(bits[lo:hi] & own).sum(1).astype(np.int64)
        # every bit set by a only, or by b only, is at least one shingle outside the overlap
        most = np.minimum(n - (np.bitwise_count(own).sum() - common), size[lo:hi] - (filled[lo:hi] - common))
        found = np.flatnonzero((100 + percent) * most >= percent * (n + size[lo:hi])) + lo

        def join(j):
            x, y = sorted((group[i], group[base + j]))
            group[group == y] = x
            out.append((doc, right[j][0]))

        if not counted:
            for j in found.tolist():
                if group[i] != group[base + j] and linked(s, right[j][1], percent):
                    join(j)
            continue
        if len(found) > 16:
            overlaps = overlaps or Overlaps([r[1] for r in left], [] if same else [r[1] for r in right])
            both = overlaps.of(i, found)
            found = found[100 * both >= percent * (n + size[found] - both)]
        else:
            found = np.array([j for j in found.tolist() if linked(s, right[j][1], percent)], np.int64)
        links[i] += copies[found].sum()
        links[base + found] += own_copies
        while len(apart := found[group[base + found] != group[i]]):
            join(apart[0])
    docs = [r[0] for r in (left if same else left + right)]
    return out, [(d, n) for d, n in zip(docs, links.tolist()) if n]


def _measure(docs: DataFrame) -> DataFrame:
    def task():
        def each(c):
            out = {"doc_id": c["doc_id"], "th": c["th"], "n": [], "h1": [], "h2": [], "low": [], "high": []}
            for t in c["text"]:
                s = shingles(b.to_pybytes() if (b := t.as_buffer()) is not None else None)
                a = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                least = minima(s).view(np.uint8)
                out["n"].append(len(s))
                out["h1"].append(int.from_bytes(a[:8], "little", signed=True))
                out["h2"].append(int.from_bytes(a[8:], "little", signed=True))
                out["low"].append(least[::2].tobytes())
                out["high"].append(least[1::2].tobytes())
            return out

        return each

    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return map_rows(hashed, ["doc_id", "th", "text"], "doc_id long, th long, n long, h1 long, h2 long, low binary, high binary", task)


def _keyed(classes: DataFrame) -> DataFrame:
    """node, key: the candidate keys of each class."""

    def task():
        def each(c):
            least = np.empty((len(c["node"]), MINIMA, 2), np.uint8)
            for k, column in enumerate(("low", "high")):
                least[:, :, k] = np.frombuffer(b"".join(c[column].to_pylist()), np.uint8).reshape(-1, MINIMA)
            return {"node": c["node"], "keys": list(keys(least.view("<u2")[:, :, 0]))}

        return each

    return map_rows(classes, ["node", "low", "high"], "node long, keys array<long>", task).select("node", F.explode("keys").alias("key"))


def _candidates(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) of classes such that linked classes are connected, and the written tables that they are read from.

    A key that holds more than LED_ROWS classes is parted by hash, each part
    finds its leaders, and those are then compared among themselves, in blocks
    of LED_ROWS too. A task never holds more of a key than two blocks.
    """
    counted = written(_keyed(classes).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    total = counted.agg(F.sum("c")).first()[0] or 0
    rows = split_join(_keyed(classes), counted, ["key"], "c", total)
    cuts = F.ceil(F.col("c") / LED_ROWS).cast("int")
    rows = rows.select("key", "node", cuts.alias("cuts"), F.pmod(F.xxhash64("node"), cuts).cast("int").alias("part"))
    rows = rows.join(classes.select("node", "low").hint("merge"), "node").select("key", "part", "node", "cuts", "low")

    def in_part(key, group):
        _, _, ids, cuts, low = zip(*group)
        low = np.frombuffer(b"".join(low), np.uint8).reshape(len(ids), -1)
        edges, leaders = lead(np.array(ids), low)
        yield from ((a, b, None, None) for a, b in edges)
        if cuts[0] > 1:
            yield from ((int(ids[i]), None, key[0], low[i].tobytes()) for i in leaders)

    def among_leaders(_, group):
        sides: dict[int, list] = {0: [], 1: []}
        alone = True
        for _, side, alone, node, low in group:
            sides[side].append((node, low))
        if sides[0] and (alone or sides[1]):
            packed = [(np.array([x for x, _ in rows]), np.frombuffer(b"".join([x for _, x in rows]), np.uint8).reshape(len(rows), -1)) for rows in sides.values() if rows]
            yield from lead_leaders(*packed[0], *(packed[1] if not alone else ()))

    found = written(stream_groups(rows, ["key", "part"], ["node"], "a long, b long, key long, low binary", in_part))
    leaders = found.where("b is null").select("key", F.col("a").alias("node"), "low")
    counts = written(leaders.groupBy("key").agg(F.count("*").alias("c"), F.ceil(F.count("*") / LED_ROWS).cast("int").alias("cuts")))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), F.when(x >= own, 0).otherwise(1).alias("side")))
    dealt = split_join(leaders, counts, ["key"], "c", counts.agg(F.sum("c")).first()[0] or 0).withColumn("job", F.explode(blocks))
    dealt = dealt.select(F.xxhash64("key", "job.i", "job.j").alias("h"), "job.side", (F.col("job.i") == F.col("job.j")).alias("alone"), "node", "low")
    more = stream_groups(dealt, ["h"], ["side"], "a long, b long", among_leaders)
    return found.where("b is not null").select("a", "b").union(more), [counted, found, counts]


def _arrays(docs: DataFrame) -> DataFrame:
    def task():
        return lambda c: {
            "node": c["node"],
            "grp": c["grp"],
            "copies": c["copies"],
            "s": [shingles(b.to_pybytes() if (b := t.as_buffer()) is not None else None).tobytes() for t in c["text"]],
        }

    return map_rows(docs, ["node", "grp", "copies", "text"], "node long, grp long, copies long, s binary", task)


def _in_tile(percent: int, counted: bool):
    """All rows of one job: side 0 against itself, or side 0 against side 1 (that may be empty). Links are
    (a, b, null), counts (a, null, n)."""

    def run(_, rows):
        sides: dict[int, list] = {0: [], 1: []}
        alone = False
        for _, side, doc, s, copies, alone in rows:
            sides[side].append((doc, np.frombuffer(s, np.uint64), copies))
        if sides[0] and (alone or sides[1]):
            links, counts = tile_links(sides[0], None if alone else sides[1], percent, counted)
            yield from ((a, b, None) for a, b in links)
            yield from ((a, None, n) for a, n in counts)

    return run


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, by jaccard_links without the count."""
    return _rows(docs, percent, with_links=False).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other doc_ids it links with) of every row: see the steps.

    1. One pass makes each text's set, its digest and its minima.
    2. Equal sets become one class.
    3. Classes that share a key and whose minima are near meet a leader of the
       key; these edges make candidate groups. Sets that are alike by less than
       about a half aren't chained, however many share a key.
    4. A candidate group is cut into tiles by size band and, where a band
       holds too many shingles, by hash; tiles of one band or of neighbouring
       bands meet in one job each. A job compares bitmaps, then exact arrays.
       Each pair of classes meets in one job, which counts its link for both.
    5. Links make components; every row of a class gets its class's. Its links
       are its class's, each as often as the other class has doc_ids, and its
       own class's other doc_ids.

    doc_id must be an integer; text ids are cast, and those that aren't numbers
    become null. Null or empty text, or text without words: no shingles, linked
    with nothing, component_id is its own doc_id. A null doc_id keeps its row
    with a null component_id and n_links. Rows that repeat come out each. Rows
    of one doc_id with different texts are documents of their own: each has the
    component and the links of its text. An empty table gives no rows. Other
    columns are ignored.
    """
    return _rows(docs, percent, with_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def _rows(docs: DataFrame, percent: int, with_links: bool) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, component_id, node, first (whether its class is its component's first) and n_links."""
    docs = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "text")
    measured = written(_measure(docs))
    full = measured.where("n > 0 and doc_id is not null")
    grouped = full.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("rows"), F.min("low").alias("low"), F.min("high").alias("high"))
    classes = written(grouped.select("h1", "h2", "n", F.monotonically_increasing_id().alias("node"), F.col("least.doc_id").alias("doc"), F.col("least.th").alias("th"), "rows", "low", "high"))
    nodes = classes.select("h1", "h2", "n", "node", "doc", "th", "rows")
    copies = full.select("h1", "h2", "n", "doc_id").distinct().groupBy("h1", "h2", "n").agg(F.count("*").alias("copies"))
    nodes = written(nodes.join(copies.hint("merge"), ["h1", "h2", "n"]))

    edges, used = _candidates(classes)
    groups = connected_components(edges).select("node", F.col("component").alias("grp"))
    groups = written(groups.join(nodes.select("node", "doc", "th", "copies").hint("merge"), "node"))
    forget(classes, *used)
    # the groups grow with the table: one way at every size
    reps = docs.withColumn("th", F.xxhash64("text")).join(groups.withColumnRenamed("doc", "doc_id").hint("merge"), ["doc_id", "th"])
    arrays = written(_arrays(reps).dropDuplicates(["node"]))
    links = written(_links(arrays, percent, with_links))
    forget(groups, arrays)

    found = connected_components(links.where("b is not null").select("a", "b"))
    found = written(nodes.join(found, "node").select("node", "component", "doc"))
    least = found.groupBy("component").agg(F.min(F.struct("doc", "node")).alias("least"), F.count("*").alias("c"))
    least = split_join(found.select("node", "component"), least, ["component"], "c", found.count()).select("node", "least")
    placed = nodes.join(least, "node", "left")
    placed = placed.withColumn("component_id", F.coalesce("least.doc", "doc")).withColumn("first", F.coalesce(F.col("least.node") == F.col("node"), F.lit(True))).drop("least")
    others = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = placed.join(others, "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    placed = placed.select("h1", "h2", "n", "rows", "node", "component_id", "first", "n_links")
    out = split_join(measured.drop("low", "high"), placed, ["h1", "h2", "n"], "rows", measured.count(), "left")
    known = F.col("doc_id").isNotNull()
    own = known & (F.col("n") > 0)  # a null id may share its text's class with others
    return out.select(
        "doc_id",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(known, F.when(own, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(own, F.col("node")).alias("node"),
        F.when(own, F.col("first")).alias("first"),
        F.when(known, F.when(own, F.col("n_links")).otherwise(F.lit(0))).alias("n_links"),
    )


def _links(arrays: DataFrame, percent: int, counted: bool) -> DataFrame:
    """a, b (links that span) and a, n (links of a) of arrays: node, grp, copies, s."""
    n = F.octet_length("s") / 8
    # a little wider than the ratio of sizes that can link, so that rounding never parts two neighbours
    band = F.floor(F.log(n) / (F.log(F.lit(100.0 / percent)) * 1.001)).cast("int")
    sized = arrays.select("*", (n + 64).cast("long").alias("weight"), band.alias("band"))
    bands = sized.groupBy("grp", "band").agg(F.ceil(F.sum("weight") / TILE_SHINGLES).cast("int").alias("cuts"), F.count("*").alias("c"))
    above = bands.select("grp", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    below = bands.select("grp", (F.col("band") + 1).alias("band"), F.col("cuts").alias("below"))
    bands = written(bands.join(above, ["grp", "band"], "left").join(below, ["grp", "band"], "left").where("c > 1 or above > 0 or below > 0"))
    # a row goes to the jobs of its tile with all tiles of its band, and of the bands above and below
    here = split_join(sized, bands, ["grp", "band"], "c", arrays.count())
    own, at = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.col("band")

    def jobs(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast(_JOBS)).cast(_JOBS)

    def job(b, i, c, j, side):
        return F.struct(b.alias("b"), i.alias("i"), c.alias("c"), j.alias("j"), F.lit(side).alias("side"))

    within = jobs("cuts", lambda k: F.when(k >= own, job(at, own, at, k, 0)).otherwise(job(at, k, at, own, 1)))
    upward = jobs("above", lambda k: job(at, own, at + 1, k, 0))
    downward = jobs("below", lambda k: job(at - 1, k, at, own, 1))
    dealt = here.select("grp", F.explode(F.concat(within, upward, downward)).alias("job"), "node", "s", "copies")
    alone = F.expr("job.b = job.c and job.i = job.j")
    tiles = dealt.select(F.xxhash64("grp", "job.b", "job.i", "job.c", "job.j").alias("h"), "job.side", "node", "s", "copies", alone.alias("alone"))
    return stream_groups(tiles, ["h"], ["side"], "a long, b long, n long", _in_tile(percent, counted))


_JOBS = "array<struct<b:int,i:int,c:int,j:int,side:int>>"


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with docs' columns: of each component the least doc_id, once.

    Rows without words and rows of a null doc_id are kept; a row without words
    that repeats is kept once. Of rows of one doc_id each text is judged by
    itself, so a text that is no copy stays. An empty table stays empty.
    """
    found = _rows(docs, PERCENT, with_links=False)
    kept = found.where("doc_id is not null and (n_shingles = 0 or (first and doc_id = component_id))")
    # of a class's rows with the least doc_id, which may differ in white space, one
    kept = kept.groupBy(F.col("doc_id").alias("_reelframe_id"), F.coalesce("node", "th").alias("node"), "n_shingles").agg(F.min("th").alias("_reelframe_th")).select("_reelframe_id", "_reelframe_th").distinct()
    marked = docs.withColumn("_reelframe_id", F.expr("try_cast(doc_id as long)")).withColumn("_reelframe_th", F.xxhash64("text"))
    once = marked.where("_reelframe_id is not null").join(kept.hint("merge"), ["_reelframe_id", "_reelframe_th"]).dropDuplicates(["_reelframe_id", "_reelframe_th"])
    return once.select(*docs.columns).union(docs.where("try_cast(doc_id as long) is null"))
