"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows
from .sampling import labelled_sample

#: Documented bounds of the training sample: rows of each class, and code points of a training text.
ROWS_PER_CLASS, MAX_CHARS = 2000, 40_000
#: Bounds of the model: mined voters, and features of the classifier.
VOTERS, FEATURES = 96, 768
#: How often a gram must occur to fire.
TIMES = (1, 2, 4, 8)
#: A mined voter's least log-odds in standard errors, and least logarithm of the ratio of its rates: precise voters
#: first, then very frequent ones, which wrong labels may make look less precise.
STRONG = [(3.0, 3.0), (5.0, 2.0)]

#: Fixed voters: common insults and slurs-free abuse of four languages, as word starts.
LEXICON = {
    "en": ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "bastard", "asshole"],
    "de": ["arschloch", "dummkopf", "vollidiot", "abschaum", "trottel", "schwachkopf"],
    "fr": ["connard", "imbécile", "salaud", "crétin", "abruti"],
    "es": ["idiota", "imbécil", "estúpid", "cabrón", "gilipollas"],
}
#: Fixed pattern voters, on the folded text.
PATTERNS = [r" you (?:are|re) (?:a|an|such|all|so) ", r" (?:shut up|go to hell|drop dead|hate you) ", r" du bist (?:ein|eine|so) ", r" tu es (?:un|une) ", r" eres (?:un|una) "]
#: Fixed function words by which a text's domain is told: a voter abstains on texts of other domains than its own.
FUNCTION_WORDS = {
    "en": "the of and to is that for with are was".split(),
    "de": "der die und das nicht ist ein zu mit auf".split(),
    "fr": "le la les des est pas dans pour par du".split(),
    "es": "el los las que del por una con se para".split(),
}

_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str | None) -> str:
    """Lower case, ASCII non-letters as spaces, a space at each end."""
    return f" {(text or '').lower().encode('utf-8', 'replace').translate(_FOLD).decode()} "


def grams(folded: str) -> set[tuple[str, int]]:
    """(gram, times): word starts of 2 to 8 letters with a space before, and whole words with a space on both
    sides, with each of TIMES that they reach."""
    count: Counter[str] = Counter()
    for w, n in Counter(folded.split()).items():
        count[f" {w} "] += n
        for k in range(2, min(len(w), 8) + 1):
            count[f" {w[:k]}"] += n
    return {(g, k) for g, n in count.items() for k in TIMES if n >= k}


def domain(folded: str) -> str:
    """The language whose function words occur most, ties by name; empty if none occurs."""
    count = Counter(folded.split())
    n, name = max((sum(count[w] for w in words), name) for name, words in FUNCTION_WORDS.items())
    return name if n else ""


def odds(one, zero, n1, n0):
    """Smoothed log-odds, and the same in standard errors, of firing in class 1 against class 0."""
    a, b = (one + 0.5) / (n1 - one + 0.5), (zero + 0.5) / (n0 - zero + 0.5)
    error = np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5) + 1 / (n1 - one + 0.5) + 1 / (n0 - zero + 0.5))
    return np.log(a / b), np.log(a / b) / error


def mine(folded: list[str], y: np.ndarray, keep: int) -> list[tuple[str, int]]:
    """The grams whose log-odds of being in a toxic text stand out most in standard errors."""
    one, zero = Counter(), Counter()
    for f, t in zip(folded, y):
        if t:
            one.update(grams(f))
    one = {g: a for g, a in one.items() if a >= 3}
    for f, t in zip(folded, y):
        if not t:
            zero.update(grams(f) & one.keys())
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    scored = []
    for g, a in one.items():
        log_odds, z = odds(a, zero[g], n1, n0)
        if log_odds > 0 and z > 2:
            scored.append((-z, g))
    return [g for _, g in sorted(scored)[:keep]]


def choose_voters(grams_: list, x: np.ndarray, y: np.ndarray, keep: int) -> list[int]:
    """Columns of x that vote: strong ones, in order of STRONG and of grams_, of which none starts as another does."""
    out, stems = [], []
    n1, n0 = y.sum(), (1 - y).sum()
    for strength, ratio in STRONG:
        for k, (g, _) in enumerate(grams_):
            one, zero = x[y == 1, k].sum(), x[y == 0, k].sum()
            if odds(one, zero, n1, n0)[1] < strength or np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (n0 + 1)) < ratio:
                continue
            stem = g.rstrip()
            if len(out) < keep and stem not in stems:
                out.append(k)
                stems.append(stem)
    return out


class LabelModel:
    """A two-class generative model of voters that fire, are silent or abstain, estimated by EM.

    Each voter has a rate of firing in either class (its accuracy). Voters that
    fire together beyond what the classes explain are correlated; a voter counts
    by one over the sum of its correlations, so copies of a signal count once.
    A round makes rates, then correlations, from the posteriors, and posteriors
    from votes, rates and correlations. A label is never a vote: labels only
    calibrate rates, as counts beside those of the posteriors.
    """

    def fit(self, votes: np.ndarray, prior: float, labels: np.ndarray | None = None, heard: np.ndarray | None = None, rounds: int = 8):
        """votes: 1 where a voter fires. prior: share of class 1. labels: classes for the calibration; without them
        the first posteriors are the shares of voters that fire, scaled to the prior. heard: 0 where a voter abstains."""
        v = votes.astype(np.float64)
        d = np.ones_like(v) if heard is None else heard.astype(np.float64)
        self.prior = min(max(prior, 0.01), 0.99)
        fired = v.mean(1)
        q = np.clip(fired * self.prior / max(fired.mean(), 1e-9), 0.02, 0.98) if labels is None else labels.astype(np.float64)
        known = np.zeros((2, 2, v.shape[1]))
        if labels is not None:
            known = np.stack([np.stack([c @ v, c @ d]) for c in (1 - q, q)])
        for i in range(rounds + 1):
            self._estimate(v, d, q, known if i else 0 * known)
            q = self.posterior(votes, heard)
        return self

    def _estimate(self, v, d, q, known):
        zero, one = ((1 - q) @ v + known[0, 0] + 0.2) / ((1 - q) @ d + known[0, 1] + 1), (q @ v + known[1, 0] + 0.5) / (q @ d + known[1, 1] + 1)
        self.rate = np.clip(np.stack([zero, one]), 1e-3, 1 - 1e-3)
        rest = (v - q[:, None] * self.rate[1] - (1 - q[:, None]) * self.rate[0]) * d
        rest -= rest.mean(0)
        s = rest.std(0)
        rho = np.abs(rest.T @ rest) / max(1, len(v)) / np.maximum(np.outer(s, s), 1e-12)
        self.correlation = np.where((rho > 0.25) & (np.outer(s, s) > 0), np.minimum(rho, 1.0), 0.0)
        np.fill_diagonal(self.correlation, 1.0)
        self.weight = 1 / self.correlation.sum(1)

    def posterior(self, votes: np.ndarray, heard: np.ndarray | None = None) -> np.ndarray:
        v = votes.astype(np.float64)
        silent = (1 if heard is None else heard.astype(np.float64)) - v
        on = np.log(self.rate[1] / self.rate[0])
        off = np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        z = np.log(self.prior / (1 - self.prior)) + v @ (self.weight * on) + silent @ (self.weight * off)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft targets, by damped Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight, w = weight / weight.sum(), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6

    def loss(w):
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - target * z) + 0.5 * ridge @ (w * w))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * w
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x
        h[np.diag_indices_from(h)] += ridge
        step, t, now = np.linalg.solve(h, g), 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-3:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


class Toxicity:
    """The fitted model; `weights` maps (gram, times) to its weight."""

    def __init__(self, weights: dict[tuple[str, int], float], patterns: list[float], bias: float):
        self.weights, self.patterns, self.bias = weights, patterns, bias

    def scorer(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        names: dict[str, int] = {}
        gained: list[list[float]] = []  # of each gram: the weight by its count, up to the most of TIMES
        for (g, k), w in self.weights.items():
            if g not in names:
                names[g] = len(gained)
                gained.append([0.0] * (max(TIMES) + 1))
            for n in range(k, max(TIMES) + 1):
                gained[names[g]][n] += w
        for g, i in names.items():
            auto.add_word(g, i)
        if names:
            auto.make_automaton()
        patterns = [(re.compile(p), w) for p, w in zip(PATTERNS, self.patterns) if w]
        most = max(TIMES)

        def score(text: str | None) -> float:
            folded = fold(text)
            z = self.bias
            if names:
                z += sum([gained[i][min(n, most)] for i, n in Counter([i for _, i in auto.iter(folded)]).items()])
            for p, w in patterns:
                if p.search(folded):
                    z += w
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> Toxicity:
    """Fit on the bounded sample of labelled rows. Without labels of both classes the fixed lexicon alone decides."""
    texts, y, prior = labelled_sample(docs, labels, "toxic", rows_per_class, max_chars)
    return fit_texts(texts, np.array(y, dtype=int), prior)


def fit_texts(texts: list[str], y: np.ndarray, prior: float) -> Toxicity:
    """Labels mine the word starts that vote, and calibrate the voters' rates. Targets of the classifier are the
    label model's posteriors, which it makes from the votes. A voter's domain is the language in which it fires
    most; it abstains on texts of another in which it doesn't fire."""
    fixed = [(f" {w}", 1) for words in LEXICON.values() for w in words]
    plain = Toxicity({g: 4.0 for g in fixed}, [1.0] * len(PATTERNS), -2.0)
    if not len(y) or y.min() == y.max():
        return plain
    folded = [fold(t) for t in texts]
    picked = list(dict.fromkeys([*mine(folded, y, FEATURES), *fixed]))
    place = {g: i for i, g in enumerate(picked)}
    x = np.zeros((len(folded), len(picked) + len(PATTERNS)), dtype=np.float32)
    for r, f in enumerate(folded):  # made again: the sets of all texts at once would fill the driver
        for g in grams(f) & place.keys():
            x[r, place[g]] = 1
        for g in fixed:
            x[r, place[g]] = g[0] in f
        for k, p in enumerate(PATTERNS):
            x[r, len(picked) + k] = re.search(p, f) is not None
    mined = choose_voters(picked, x, y, VOTERS)
    voters = mined + [k for k in [*(place[g] for g in fixed if place[g] not in mined), *range(len(picked), x.shape[1])] if x[:, k].any()]
    if not voters:
        return plain
    votes = x[:, voters]
    spoken = np.array([domain(f) for f in folded])
    names = sorted(set(spoken.tolist()))
    own = np.stack([votes[spoken == d].mean(0) for d in names]).argmax(0)
    heard = (spoken[:, None] == np.array(names)[own][None, :]) | (votes > 0)
    target = LabelModel().fit(votes, float(y.mean()), y, heard).posterior(votes, heard)
    one = target.sum()
    weight = target / max(one, 1e-9) + (1 - target) / max(len(target) - one, 1e-9)  # both classes weigh alike
    w, b = logistic(x, target, weight)
    kept = {g: float(v) for g, v in zip(picked, w) if abs(v) > 1e-4}
    return Toxicity(kept, [float(v) for v in w[len(picked) :]], b)


def score_toxicity(docs: DataFrame, model: Toxicity, key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of each row's whole text. Null or empty text has the score of no signal; equal
    texts have equal scores and rows that repeat are scored each; an empty table gives no rows; other
    columns are ignored."""
    handed, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def task():
        score = handed.value.scorer()
        return lambda c: {key: c[key], "score": [score(t.as_py()) for t in c["text"]]}

    return map_rows(docs, [key, "text"], f"`{key}` {kind}, score double", task)
