"""Embedding near-dedup by collision counting over one-dimensional projections."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import acos, comb, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, split_join, stream_groups, written
from .components import connected_components

THRESHOLD = 0.93
#: Projections whose collisions are counted, half-width of a query's window in standard deviations of a threshold
#: pair's difference, and the chance that a threshold pair misses the count.
PROJECTIONS, WIDTH, MISS = 32, 2.0, 1e-6
#: Where cells are asked for, the chance that a pair at the threshold itself shares no cell of any table. Nearer pairs
#: are missed less: at a cosine of 0.97 the chance is about a fifth of it.
CELL_MISS = 0.02
#: Rows, and components of all rows, that a side of a job holds at most.
BLOCK, VALUES = 16_384, 1 << 22


@lru_cache(maxsize=64)
def directions(count: int, dim: int) -> np.ndarray:
    """At most dim orthonormal directions, as columns."""
    return np.linalg.qr(np.random.default_rng([1, dim]).normal(size=(dim, dim)))[0][:, : min(count, dim)]


def half_width(threshold: float, dim: int) -> float:
    return WIDTH * sqrt(2 * (1 - threshold) / dim)


@lru_cache(maxsize=64)
def least_count(dim: int) -> int:
    """The count of window collisions that a threshold pair misses with a chance of at most MISS.

    The pair's difference has a random direction, of which a projection is a
    coordinate. Coordinates are negatively dependent, so that the binomial law
    bounds the chance of few collisions from above.
    """
    x = min(1.0, WIDTH / sqrt(dim))
    if x == 1.0:
        return min(PROJECTIONS, dim)  # the window holds the whole difference
    grid = (np.arange(200_000) + 0.5) / 200_000
    density = (1 - grid * grid) ** ((dim - 3) / 2)
    p, n = float(density[grid <= x].sum() / density.sum()), min(PROJECTIONS, dim)
    tail, c = 0.0, 0
    while c < n and (tail := tail + comb(n, c) * p**c * (1 - p) ** (n - c)) <= MISS:
        c += 1
    return c


def tables_of(k: int, threshold: float, miss: float = CELL_MISS) -> int:
    """Tables of cells of k projections that bring the chance of a miss to `miss`."""
    return 1 if k == 0 else int(np.ceil(log(miss) / log(1 - (1 - acos(threshold) / pi) ** k)))


def cell_codes(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """For each row and table the cell: on which side of zero each of k further projections lies. k = 0: one cell."""
    out = np.zeros((len(units), tables), np.int64)
    for t in range(tables if k else 0):
        planes = np.random.default_rng([2, units.shape[1], t]).normal(size=(units.shape[1], k))
        out[:, t] = (units @ planes > 0) @ (1 << np.arange(k, dtype=np.int64))
    return out


class Windows:
    """Sorted projections of a side; a query's window about its own value is a run of ranks in each."""

    def __init__(self, units: np.ndarray, threshold: float):
        self.at = units @ directions(PROJECTIONS, units.shape[1])
        self.half = half_width(threshold, units.shape[1]) + 1e-9
        self.order = np.sort(self.at, axis=0)
        rank = np.argsort(np.argsort(self.at, axis=0, kind="stable"), axis=0, kind="stable")
        kind = np.uint16 if len(units) < 1 << 16 else np.uint32
        self.rank, self.kind = np.ascontiguousarray(rank.T.astype(kind)), kind

    def collisions(self, queries: np.ndarray, first: int) -> np.ndarray:
        """Of each query (its projections) and each row from `first` on, the projections in which they collide."""
        count = np.zeros((len(queries), self.rank.shape[1] - first), np.uint8)
        for j, rank in enumerate(self.rank):
            lo = np.searchsorted(self.order[:, j], queries[:, j] - self.half)
            size = np.searchsorted(self.order[:, j], queries[:, j] + self.half, side="right") - lo
            # ranks below the window wrap round to large numbers
            count += (rank[None, first:] - lo.astype(self.kind)[:, None]) < size.astype(self.kind)[:, None]
        return count


def job_links(a, b, table: int, threshold: float, k: int = 0):
    """(links of each row of a, links of each row of b, links as id pairs that span them).

    a, b: (ids, multiplicities, units); b None: a against itself. A pair that
    shares a cell of an earlier table was counted there.
    """
    ids, many, units = a
    other = a if b is None else b
    windows, queries = Windows(other[2], threshold), units @ directions(PROJECTIONS, units.shape[1])
    least = least_count(units.shape[1])
    codes = [cell_codes(u, k, table) if table and k else None for u in (units, other[2])]
    base = 0 if b is None else len(ids)
    group = np.arange(base + len(other[0]))
    na, nb, edges = np.zeros(len(ids), np.int64), np.zeros(len(other[0]), np.int64), []
    for lo in range(0, len(ids), 64):
        rows = np.arange(lo, min(lo + 64, len(ids)))
        first = lo if b is None else 0
        i, j = np.nonzero(windows.collisions(queries[rows], first) >= least)
        i, j = rows[i], j + first
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 200_000):
            x, y = i[s : s + 200_000], j[s : s + 200_000]
            near = np.einsum("nd,nd->n", units[x], other[2][y]) >= threshold
            if table and k:
                near &= ~(codes[0][x] == codes[1][y]).any(1)
            x, y = x[near], y[near]
            na += np.bincount(x, other[1][y], len(ids)).astype(np.int64)
            nb += np.bincount(y, many[x], len(other[0])).astype(np.int64)
            while len(apart := np.flatnonzero(group[x] != group[base + y])):
                x, y = x[apart], y[apart]
                p, q = sorted((group[x[0]], group[base + y[0]]))
                group[group == q] = p
                edges.append((int(ids[x[0]]), int(other[0][y[0]])))
    return (na + nb, None, edges) if b is None else (na, nb, edges)


def _unit(data: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(data, kind).astype(np.float64)
    return x / np.linalg.norm(x)


def _marked(vectors: DataFrame, key: str, label: str, vector: str, with_vector: bool) -> DataFrame:
    """id, label, raw (a digest, null where the vector links with nothing), dim and, asked for, vec of each row."""
    kind = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64

    def task():
        def each(c):
            out = {"id": c["id"], "label": c["label"], "raw": [], "dim": [], "vec": []}
            for v in c["vector"].to_pylist():
                x = np.asarray(v, kind) if v and None not in v else None
                size = np.linalg.norm(x.astype(np.float64)) if x is not None and np.isfinite(x).all() else 0.0
                fine = size > 0 and np.isfinite(size)
                out["raw"].append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fine else None)
                out["dim"].append(len(x) if fine else 0)
                out["vec"].append(x.tobytes() if fine else None)
            return out

        return each

    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    schema = f"id long, label {dict(vectors.dtypes)[label]}, raw binary, dim int" + (", vec binary" if with_vector else "")
    return map_rows(named, ["id", "label", "vector"], schema, task)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", label: str = "label", vector: str = "embedding", cell_rows: int | None = None, cell_miss: float = CELL_MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; pairs of one label with a cosine of threshold or more link.

    Equal vectors of a label are one class, which is compared once. A label is
    one cell, whatever its size, so whether two rows link depends on them alone.
    A cell beyond BLOCK rows or VALUES components is cut into blocks, and any two
    blocks meet in a job, which is quadratic in a label's distinct vectors. A
    caller who would rather miss links may ask for cells of about cell_rows: a
    label is then dealt to cells by the signs of k projections, k growing with
    the logarithm of its size, in as many tables as bring the chance that a
    threshold pair meets in none to cell_miss. A job sorts PROJECTIONS projections, counts in how many of them a row lies in another's
    window, and verifies the pairs that pass the calibrated count, each in the
    first table that it shares. Jobs return counts and a spanning set of links,
    so a group's pairs are never written out.

    Null labels and ids, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing and are kept as their own
    component. Vectors of unlike length don't link. Rows that repeat are
    vectors of their own. An empty table gives no rows. Other columns are
    ignored.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    rows = written(_marked(vectors, key, label, vector, False))
    good = "raw is not null and label is not null and id is not null"
    counts = rows.where(good).select("label", "raw").distinct().groupBy("label").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / cell_rows))) if cell_rows else F.lit(0)
    counts = written(counts.withColumn("k", k.cast("int")))
    classes = _marked(vectors, key, label, vector, True).where(good).groupBy("label", "raw").agg(F.min("id").alias("node"), F.count("*").alias("many"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    sized = split_join(classes, counts, ["label"], "n", total)

    def task():
        def each(c):
            ks, vecs = c["k"].to_pylist(), c["vec"].to_pylist()
            codes: list = [None] * len(ks)
            groups: dict[tuple, list[int]] = {}
            for i, (n, data) in enumerate(zip(ks, vecs)):
                groups.setdefault((n, len(data)), []).append(i)
            for (n, _), at in groups.items():
                found = cell_codes(np.array([_unit(vecs[i], kind) for i in at]), n, tables_of(n, threshold, cell_miss))
                for i, row in zip(at, found):
                    codes[i] = row.tolist()
            return {**c, "codes": codes}

        return each

    names, label_kind = ["label", "raw", "node", "many", "dim", "vec", "k"], dict(rows.dtypes)["label"]
    coded = written(map_rows(sized, names, f"label {label_kind}, raw binary, node long, many long, dim int, vec binary, k int, codes array<long>", task))
    cell = ["label", "dim", "t", "code"]
    cells = coded.select("label", "dim", F.posexplode("codes").alias("t", "code"), "node", "many", "vec", "k")
    sizes = written(cells.groupBy(*cell).agg(F.count("*").alias("c")).where("c > 1").withColumn("cuts", F.ceil(F.col("c") * F.greatest(F.lit(1 / BLOCK), F.col("dim") / VALUES)).cast("int")))
    rows_in_cells = sizes.agg(F.sum("c")).first()[0] or 0
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    jobs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), F.when(x >= own, 0).otherwise(1).alias("side")))
    dealt = split_join(cells, sizes, cell, "c", rows_in_cells).withColumn("job", F.explode(jobs))
    dealt = dealt.select(F.xxhash64(*cell, "job.i", "job.j").alias("h"), "t", "k", (F.col("job.i") == F.col("job.j")).alias("self"), "job.side", "node", "many", "vec")

    def in_job(_, group):
        sides: dict[int, list] = {0: [], 1: []}
        t, k, alone = 0, 0, True
        for _, t, k, alone, side, *row in group:
            sides[side].append(row)

        def packed(side):
            ids, many, vecs = zip(*side)
            return np.array(ids), np.array(many, np.float64), np.array([_unit(v, kind) for v in vecs])

        if not sides[0] or not (alone or sides[1]):
            return
        a, b = packed(sides[0]), None if alone else packed(sides[1])
        na, nb, edges = job_links(a, b, t, threshold, k)
        yield from ((int(x), None, int(n)) for x, n in zip(a[0], na) if n)
        if b is not None:
            yield from ((int(x), None, int(n)) for x, n in zip(b[0], nb) if n)
        yield from ((x, y, None) for x, y in edges)

    found = written(stream_groups(dealt, ["h"], ["side"], "a long, b long, n long", in_job))
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("d"))
    component = connected_components(found.where("b is not null").select("a", "b"))
    placed = coded.select("label", "raw", "node", "many").join(degree, F.col("node") == degree["a"], "left").join(component.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    placed = placed.select("label", "raw", "many", (F.coalesce("d", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "node").alias("c"))
    out = split_join(rows, placed, ["label", "raw"], "many", rows.count(), "left")
    known = F.col("id").isNotNull()
    component_id = F.when(known, F.coalesce("c", "id"))
    return out.select(F.col("id").alias("vec_id"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))
