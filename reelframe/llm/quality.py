"""Quality by Bradley-Terry ranking of document pairs."""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_rows, map_rows, written
from .sampling import known_labels, labelled_sample

#: Documented bounds: training rows of each class, code points of a training text, preference pairs.
ROWS_PER_CLASS, MAX_CHARS, PAIRS = 3000, 40_000, 60_000

_SYMBOLS = b"#$%&*@^~|<>{}[]\\=+_/"
_UPPER, _LOWER, _DIGIT, _STOP = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:!?"


def measures(text: str | None) -> list[float]:
    """Shares that tell prose from junk, each between 0 and 1, over the whole text."""
    data = (text or "").encode("utf-8", "replace")
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, lower = size - len(data.translate(None, _UPPER)), size - len(data.translate(None, _LOWER))
    lines = [x for x in data.split(b"\n") if x]
    return [
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        min(1.0, data.count(b"|") / n),
        min(1.0, data.count(b"!!") / n),
        (size - len(data.translate(None, _SYMBOLS))) / size,
        min(1.0, (size - len(data.translate(None, _SYMBOLS))) / n / 3),
        upper / max(1, upper + lower),
        (size - len(data.translate(None, _DIGIT))) / size,
        min(1.0, (size - len(data.translate(None, _STOP))) / n),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, size / n / 20),
        sum([len(w) <= 3 for w in words]) / n,
        min(1.0, np.log1p(len(words)) / 12),
    ]


def expand(m: np.ndarray) -> np.ndarray:
    """Each share, its square root and its square: the ranking stays linear in these."""
    return np.concatenate([m, np.sqrt(m), m * m], axis=1)


#: Bins of the histogram of raw scores, over this many standard deviations of the sample's on either side.
BINS, REACH = 4096, 8.0


class Quality:
    """raw = w . x; score = sigmoid(slope * (raw - cut)), where cut is a quantile of raw scores, see cut_at_quantile."""

    def __init__(self, mean, scale, w, cut: float, slope: float, spread: float = 1.0):
        self.mean, self.scale, self.w, self.cut, self.slope, self.spread = mean, scale, w, cut, slope, spread

    def raw(self, m: np.ndarray) -> np.ndarray:
        return ((expand(m) - self.mean) / self.scale) @ self.w

    def score(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(m) - self.cut), -30, 30)))

    def with_cut(self, cut: float) -> Quality:
        return Quality(self.mean, self.scale, self.w, cut, self.slope, self.spread)


def bradley_terry(better: np.ndarray, worse: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights whose score differences explain the preferences, by Newton steps on the logistic loss."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is the wrong way
        g = -(d.T @ p) / len(d) + l2 * w
        h = (d.T * (p * (1 - p))) @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_measures(m: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Quality:
    """m: measures of labelled rows; y: 1 better, 0 worse. The cut is the middle of the classes' medians until documents set it."""
    x = expand(m) if len(m) else np.zeros((0, 42))
    if not len(y) or y.min() == y.max():
        k = x.shape[1] if len(x) else 42
        return Quality(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = bradley_terry(z[rng.choice(good, pairs)], z[rng.choice(bad, pairs)])
    raw = z @ w
    cut, spread = float((np.median(raw[good]) + np.median(raw[bad])) / 2), float(raw.std()) or 1.0
    slope = 4 / max(1e-6, float(np.abs(np.median(raw[good]) - np.median(raw[bad]))) / 2)
    return Quality(mean, scale, w, cut, slope, spread)


def quantile_cut(every: np.ndarray, labelled: np.ndarray, share: float, error: float) -> int:
    """The first bin above the cut, from the counts by bin of all rows and of the labelled ones.

    The cut is the quantile of the labelled rows at `share`, which they tell to
    within `error`. Of the cuts between their quantiles at share - error and
    share + error the one is taken that has the fewest of all rows within a
    hundredth of the bins about it; ties by the nearest to the quantile itself.
    """
    below = np.concatenate([[0], np.cumsum(labelled)]) / max(1, labelled.sum())  # of each cut: the share of rows below it
    lo = max(1, int(np.searchsorted(below, share - error, side="right")) - 1)
    hi = min(BINS - 1, max(lo, int(np.searchsorted(below, share + error, side="left"))))
    near = BINS // 200
    sums = np.concatenate([[0], np.cumsum(every)])
    cuts = np.arange(lo, hi + 1)
    about = sums[np.minimum(cuts + near, BINS)] - sums[np.maximum(cuts - near, 0)]
    return int(cuts[np.lexsort((np.abs(below[cuts] - share), about))[0]])


def raw_scores(docs: DataFrame, model: Quality, key: str = "doc_id") -> DataFrame:
    """key and raw score of each row's whole text."""
    handed, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def task():
        model = handed.value
        return lambda c: {key: c[key], "raw": model.raw(np.array([measures(t.as_py()) for t in c["text"]])).tolist()}

    return map_rows(docs, [key, "text"], f"`{key}` {kind}, raw double", task)


def cut_at_quantile(raws: DataFrame, labels: DataFrame, model: Quality, key: str = "doc_id") -> Quality:
    """The model with its cut at the quantile of the raw scores of all labelled documents that leaves their share
    of class 0 below it, placed where fewest of all documents are.

    Labelled documents tell that share to within two standard errors. They stand
    for the documents whose labels are sought, while many copies of a text, or a
    large source, would move a quantile of all rows. Scores come as histograms
    of BINS bins, so a bounded number of rows reaches the driver.
    """
    low, width = model.cut - REACH * model.spread, 2 * REACH * model.spread / BINS
    bins = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("raw") - low) / width))).cast("int").alias("bin")
    every, labelled, bad = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64), 0
    for r in raws.groupBy(bins).agg(F.count("*").alias("n")).collect():
        every[r["bin"]] = r["n"]
    once = raws.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.min("raw").alias("raw"))
    for r in once.join(known_labels(labels, "quality"), "doc_id").groupBy(bins).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("bad")).collect():
        labelled[r["bin"]] = r["n"]
        bad += r["bad"]
    n = int(labelled.sum())
    if not n or bad in (0, n):
        return model
    share = bad / n
    return model.with_cut(low + width * quantile_cut(every, labelled, share, 2 * float(np.sqrt(share * (1 - share) / n))))


def fit_ranking(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> Quality:
    """The ranking, from the bounded sample of labelled rows."""
    texts, y, _ = labelled_sample(docs, labels, "quality", rows_per_class, max_chars)
    return fit_measures(np.array([measures(t) for t in texts]), np.array(y, dtype=int))


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> Quality:
    """The ranking with its cut, which all labelled rows and all rows of docs set. Without labels of both classes
    every score is 0.5; without documents the cut is the middle of the classes."""
    model = fit_ranking(docs, labels, rows_per_class, max_chars)
    raws = written(raw_scores(docs, model))
    model = cut_at_quantile(raws, labels, model)
    forget(raws)
    return model


def rank_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """fit_quality and score_quality in one pass over the texts: raw scores are written, cut at their quantile and
    scored. key and score of every row, as score_quality gives them."""
    model = fit_ranking(docs, labels, rows_per_class, max_chars)
    raws = written(raw_scores(docs, model, key))
    model = cut_at_quantile(raws, labels, model, key)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * (F.col("raw") - model.cut)))
    return raws.select(key, (1 / (1 + F.exp(-z))).alias("score"))


def score_quality(docs: DataFrame, model: Quality, key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of each row's whole text. Null text counts as empty; equal texts have equal scores,
    and rows that repeat are scored each; an empty table gives no rows; other columns are ignored."""
    handed, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def task():
        model = handed.value
        return lambda c: {key: c[key], "score": model.score(np.array([measures(t.as_py()) for t in c["text"]])).tolist()}

    return map_rows(docs, [key, "text"], f"`{key}` {kind}, score double", task)


def keep_quality(docs: DataFrame, model: Quality, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is threshold or more. Null text counts as empty text, a null
    doc_id is kept or dropped by its text, rows that repeat are judged each, and an empty table stays empty."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        model = handed.value
        return lambda texts: model.score(np.array([measures(t.as_py()) for t in texts])) >= threshold

    return keep_rows(docs, "text", task)
