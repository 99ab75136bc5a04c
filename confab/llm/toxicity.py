"""Toxicity by class-conditional Kneser-Ney models over the characters of words."""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, lean, rows_of, stored
from .quality import held_out, training_rows

#: Labelled rows and bytes of text of each class from which the models are counted, at most. Documented bounds of
#: the training sample; they also bound the tables that are broadcast.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 20_000, 4 << 20, 64
#: Characters of context, and the discount of all orders.
ORDER, DISCOUNT = 7, 0.75
#: Discount of a class's own counts: what it has seen twice only is left to the backoff.
CLASS_DISCOUNT = 2.0
#: Sequences of characters seen fewer times are left to the shared backoff.
LEAST = 2
#: Words of the windows over which log-likelihoods are compared, besides the whole text.
WINDOWS = (4, 16, 64)
#: Words of more characters than LONG, as in text without white space, are read as pieces of PIECE characters. A piece
#: begins ORDER characters before the last one's end, so every sequence of a context and a character is in one of them.
LONG, PIECE = 64, 24
#: A worker's memory of words.
CACHE = 400_000
_OUTER = re.compile(r"^\W+|\W+$")


def words_of(text: str | None) -> list[str]:
    """Words of a whole text, long ones in pieces that overlap."""
    words = (text or "").split()
    if not any(len(w) > LONG for w in words):
        return words
    step = PIECE - ORDER
    return [p for w in words for p in ([w[k : k + PIECE] for k in range(0, len(w) - ORDER, step)] if len(w) > LONG else (w,))]


def normal(word: str) -> str:
    """Lower case, without marks at the ends; ^ and $ stand for the ends."""
    w = _OUTER.sub("", word.lower())
    return f"^{w}$" if w else ""


def _grams(word: str) -> Iterator[str]:
    for i in range(1, len(word)):
        yield word[max(0, i - ORDER) : i + 1]


@dataclass
class Model:
    """log p(next | context, toxic) - log p(next | context, ordinary) by sequence, and the logistic curve over
    features()."""

    by_gram: dict[str, float]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def count_models(words: tuple[Counter, Counter]) -> dict[str, float]:
    """Log-likelihood ratios of sequences from the words of ordinary (0) and toxic (1) texts.

    Each class has its own counts of the longest sequences. Both back off, with absolute discounting, to one shared
    distribution of continuations, itself interpolated down the orders from counts of distinct left neighbours in both
    classes; so a sequence too rare to tell weighs the same for both, and one that neither has seen has no ratio.
    """
    grams: tuple[Counter, Counter] = (Counter(), Counter())
    for c in (0, 1):
        for word, n in words[c].items():
            for g in _grams(word):
                grams[c][g] += n
    seen = [g for g in set(grams[0]) | set(grams[1]) if grams[0][g] + grams[1][g] >= LEAST]
    # continuations[m]: sequences of m context characters and a next one -> distinct left neighbours
    left: dict[str, int] = Counter()
    current, done = set(seen), set()
    while current:
        # A sequence is met at the start of a word and amid others; it is one left neighbour.
        done |= current
        for g in current:
            if len(g) > 1:
                left[g[1:]] += 1
        current = {g[1:] for g in current if len(g) > 1} - done
    total: dict[str, int] = defaultdict(int)
    kinds: dict[str, int] = defaultdict(int)
    for g, n in left.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    memo: dict[str, float] = {"": 1 / 256}

    def shared(g: str) -> float:
        got = memo.get(g)
        if got is None:
            t = total.get(g[:-1], 0)
            below = shared(g[1:])
            got = memo[g] = (max(left.get(g, 0) - DISCOUNT, 0) + DISCOUNT * kinds[g[:-1]] * below) / t if t else below
        return got

    n_ctx: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
    spare: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
    for c in (0, 1):
        for g in seen:
            if n := grams[c][g]:
                n_ctx[c][g[:-1]] += n
                spare[c][g[:-1]] += min(n, CLASS_DISCOUNT)

    def likelihood(c: int, g: str, below: float) -> float:
        x = g[:-1]
        return (max(grams[c][g] - CLASS_DISCOUNT, 0) + spare[c][x] * below) / n_ctx[c][x] if x in n_ctx[c] else below

    return {g: math.log(likelihood(1, g, below) / likelihood(0, g, below)) for g in seen for below in (shared(g[1:]),)}


class WordRatios(dict):
    """Log-likelihood ratio of a word, toxic over ordinary, kept while there is room."""

    def __init__(self, by_gram: dict[str, float]):
        super().__init__()
        self.by_gram = by_gram

    def __missing__(self, word: str) -> float:
        ratio = self.by_gram.get
        got = sum(ratio(g, 0.0) for g in _grams(normal(word)))
        if len(self) >= CACHE:
            self.clear()
        self[word] = got
        return got


#: Numbers of features() for one text.
N_FEATURES = 5 + len(WINDOWS)


def features(text: str | None, ratios: WordRatios) -> list[float]:
    """Length-normalised log-likelihood ratios of a whole text: of all its words, of its most toxic windows, and of its
    three most toxic different words. Text without words gives zeros."""
    words = words_of(text)
    if not words:
        return [0.0] * N_FEATURES
    r = np.fromiter(map(ratios.__getitem__, words), np.float64, len(words))
    r = np.clip(r, -12, 12)
    sums = np.concatenate([[0.0], np.cumsum(r)])
    kinds = set(words)
    each = np.clip(np.fromiter(map(ratios.__getitem__, kinds), np.float64, len(kinds)), -12, 12)
    out = [float(r.mean()), float(np.maximum(each - 2, 0).sum() / len(each) ** 0.5)]
    for w in WINDOWS:
        k = min(w, len(r))
        out.append(float((sums[k:] - sums[:-k]).max() / w))
    top = np.sort(np.partition(each, max(len(each) - 3, 0))[-3:])[::-1]
    top = np.concatenate([top, np.zeros(3 - len(top))])
    return [*out, *top.tolist()]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant) by Newton's method on standardised columns, both classes weighing the same."""
    if not len(x):
        return np.zeros(x.shape[1] + 1), np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (share * (y - p)) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _words(texts: list[str]) -> Counter:
    """Words and the number of different words that stand before them, over all texts: a word that one text repeats,
    or that stands in copies of one text, is no evidence about a class."""
    seen: set[int] = set()
    raw: Counter = Counter()
    for t in texts:
        words = words_of(t)
        for pair in zip(["", *words], words, strict=False):
            if (h := xxhash.xxh3_64_intdigest("\0".join(pair))) not in seen:
                seen.add(h)
                raw[pair[1]] += 1
    out: Counter = Counter()
    for w, n in raw.items():
        if k := normal(w):
            out[k] += n
    return out


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """A model from (doc_id, text, y). The logistic curve is fitted on ratios that come from the other half of the
    rows, so that no text is judged by its own counts; the tables are then counted from all rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    x, y = [], []
    for half in (0, 1):
        other = [r for k, r in enumerate(rows) if k % 2 != half]
        ratios = WordRatios(count_models(tuple(_words([t for _, t, c in other if c == k]) for k in (0, 1))))  # type: ignore[arg-type]
        for _, t, c in rows[half::2]:
            x.append(features(t, ratios))
            y.append(c)
    weights, mean, scale = fit_logistic(np.array(x, float).reshape(len(x), N_FEATURES), np.array(y, float))
    by_gram = count_models(tuple(_words([t for _, t, c in rows if c == k]) for k in (0, 1)))  # type: ignore[arg-type]
    return Model(by_gram, weights, mean, scale)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model from labelled texts of at most ``rows`` ids and ``size`` bytes a class (each row counts ROW_BYTES more,
    so rows without text are bounded too), none of them held out. Texts are read once; what is labelled is kept, and the
    sample is chosen from that."""
    found = stored(training_rows(docs, labels, label_col, rows))
    found = bounded_sample(found, F.xxhash64("doc_id", "text"), F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES, size, by="y")
    return fit([(r.doc_id, r.text, r.y) for r in found.select("doc_id", "text", "y").collect()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of label 1, from the whole text alone. Null text counts as empty; a null id stays
    null; repeated rows give repeated rows; other columns are not read. No shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        ratios = WordRatios(m.by_gram)
        for batch in it:
            got = [(i, features(t, ratios)) for i, t in rows_of(batch, "i", "t")]
            if got:
                x = (np.array([f for _, f in got]) - m.mean) / m.scale
                s = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array(s)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; see train() and score(). An empty table gives an
    empty result; without usable labels every score is 0.5."""
    out = score(docs, train(docs, labels, label_col))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
