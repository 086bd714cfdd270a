"""A quality classifier by Bradley-Terry pairwise ranking.

From labelled documents, pairs of a better and a worse one are drawn; weights are fitted by logistic loss on the difference of
their features (shapes of words and lines, shares of byte classes, and hashed three-letter sequences), so that the better
document gets the higher strength. The strength's quantile at which the training labels
divide becomes the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import slices, utf8

#: Most labelled documents and pairs that the weights are fitted on; folds, and the one held out.
SAMPLE, PAIRS, FOLDS, HELD_OUT = 12_000, 120_000, 5, 0
#: A document is accepted from this score on.
CUT = 0.3

_BYTES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\x0b\x0c",
    "line": b"\n\r",
    "stop": b".?",
    "shout": b"!",
    "comma": b",;:",
    "quote": b"'\"()[]-",
    "markup": b"<>{}=\\/_^~`",
    "bar": b"|",
    "star": b"*#$%&@+",
    "wide": bytes(range(128, 256)),
    "control": bytes([*range(9), *range(14, 32), 127]),
}
_CLASS = np.full(256, len(_BYTES), np.int64)
for _i, _v in enumerate(_BYTES.values()):
    _CLASS[np.frombuffer(_v, np.uint8)] = _i
SHAPES = ("log_words", "word_length", "distinct_words", "top_word", "distinct_lines", "line_words", "repeated_triples", "short_words", "upper_words", "letterless_words")
NAMES = [*_BYTES, "other", *SHAPES]
#: Buckets of three-byte sequences (a power of two); how much stronger their weights are held down than the others.
GRAMS, GRAM_DECAY = 64, 10.0
WIDTH = len(NAMES) + GRAMS
#: Pairs whose differences are in memory at a time.
BLOCK = 10_000
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(text: bytes) -> np.ndarray:
    """Shares of byte classes, shapes of words and lines, and shares of hashed sequences of three bytes (A-Z lower-cased), over the
    whole text; all 0 for the empty text."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    if len(raw) > 2:
        for i in range(0, len(raw) - 2, 1 << 20):
            low = _LOWER[raw[i : i + (1 << 20) + 2]]
            out[len(NAMES) :] += np.bincount(((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1), minlength=GRAMS)
        out[len(NAMES) :] /= len(raw) - 2
    shares = np.bincount(_CLASS, weights=counts, minlength=len(_BYTES) + 1)
    out[: len(shares)] = shares / len(text)
    words = text.split()
    n = len(words)
    if not n:
        return out
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(0, n - 2)
    values = (
        np.log1p(n),
        np.log1p(sum(len(w) * c for w, c in seen.items()) / n),
        len(seen) / n**0.9,
        max(seen.values()) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples else 0.0,
        sum(c for w, c in seen.items() if len(w) < 3) / n,
        sum(c for w, c in seen.items() if w.isupper()) / n,
        sum(c for w, c in seen.items() if not w[:1].isalpha() and w[0] < 128) / n,
    )
    out[len(shares) : len(NAMES)] = values
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Each shape and class, its square root and whether it is about 0: bends that one weight can't make; sequences by their roots."""
    plain, grams = x[:, : len(NAMES)], x[:, len(NAMES) :]
    return np.hstack([plain, np.sqrt(np.abs(plain)), np.exp(-np.abs(plain) * 50), np.sqrt(grams)])


@dataclass(frozen=True)
class Model:
    """Strength is ``weights . (expand(features) - centre) / spread``; ``slope`` and ``threshold`` turn it into a score."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, and ``CUT`` where the strength is the threshold."""
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, decay: float = 1e-3, seed: int = 7) -> Model:
    """Weights from pairs (a document of label 1, one of label 0); without both labels every document scores the same, 0.5.

    Minimised by Newton's method: the loss is convex and has a weight per feature only. Differences are made block by block.
    """
    z = expand(x.reshape(-1, WIDTH))
    centre = z.mean(0) if len(z) else np.zeros(z.shape[1])
    spread = z.std(0) + 1e-6 if len(z) else np.ones(z.shape[1])
    good, bad = np.flatnonzero(better == 1), np.flatnonzero(better == 0)
    if not len(good) or not len(bad):
        return Model(centre, spread, np.zeros(z.shape[1]), 1.0, np.log(CUT / (1 - CUT)))
    z = np.clip((z - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    upper, lower = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(z.shape[1])
    held = decay * np.where(np.arange(len(w)) < len(w) - GRAMS, 1.0, GRAM_DECAY)
    for _ in range(25):
        gradient, hessian = held * w, np.diag(held)
        for i in range(0, pairs, BLOCK):
            d = z[upper[i : i + BLOCK]] - z[lower[i : i + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient -= p @ d / pairs
            hessian += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    order = np.sort(strength)
    truth = better[np.argsort(strength, kind="stable")]
    # The quantile with the best mean of the two classes' recall, taken in the middle of its gap.
    above_good = len(good) - np.concatenate([[0], np.cumsum(truth == 1)])
    below_bad = np.concatenate([[0], np.cumsum(truth == 0)])
    balance = above_good / len(good) + below_bad / len(bad)
    k = int(np.argmax(balance))
    at = order[0] - 1 if k == 0 else order[-1] + 1 if k == len(order) else (order[k - 1] + order[k]) / 2
    return Model(centre, spread, w, 1.0, float(at))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``sample`` of them, taken by their ids' hash.

    Rows that repeat a doc_id count once, with the least of their texts; labels that contradict each other count as the worse one.
    """
    known = labels.select("doc_id", "quality").dropna().filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's size is bounded by the parameter, so it can be broadcast; a partial aggregate leaves one row of each id.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), part.column("quality"), pa.array([features(t).astype("<f8").tobytes() for t in utf8(part.column("text"))], pa.binary())], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, quality int, x binary").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.frombuffer(b"".join(map(bytes, got["x"])), "<f8"), got["quality"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; only the text is an input, whole however long it is. Null counts as empty; equal texts and
    repeated rows get equal scores; an empty table gives no rows; other columns are ignored, whatever their names."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t) for t in utf8(part.column("text"))]).reshape(-1, WIDTH)
                yield pa.record_batch([part.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``. A row without doc_id is not held out."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns: the columns pass through the scoring step."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t) for t in utf8(part.column("text"))]).reshape(-1, WIDTH)
                yield part.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema).select(names)
