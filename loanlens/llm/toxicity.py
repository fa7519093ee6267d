"""Toxicity scores from subword bags.

A word is the mean of the vectors of its character n-grams and of itself, a text the mean of its words; a
linear softmax turns that into a probability. Vectors and softmax are trained together (Adam, full batches,
numpy). As everything before the softmax is a mean, scoring needs one number per n-gram; misspellings of a
word share most of its n-grams and so its number.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loanlens.llm.common import hash_sample, slices

#: Labelled documents of labels 0 and 1 that a model is fitted on (whole texts).
TRAIN = {0: 4000, 1: 1500}
BUCKETS, DIMENSIONS, SIZES = 1 << 17, 8, (3, 4, 5)
ROUNDS = 60
#: An n-gram met in fewer (word, document) pairs of the sample has the number 0.
LEAST_MET = 5
#: Rates of vectors and softmax. The damping (over the rarer label's documents) keeps the steps of rare n-grams, whose
#: gradients are small, small as well.
RATE, SOFTMAX_RATE, DAMPING = 1.0, 0.1, 0.015
#: Words whose numbers a task keeps; then it starts over.
CACHE = 500_000
_BASE = np.uint64(0x100000001B3)
_SEED = 11


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of anything but white space, without punctuation at their ends."""
    return [w for w in (x.strip(".,;:!?\"'()[]{}|*#$%&<>-") for x in (text or "").lower().split()) if w]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``<word>`` and of the word itself, and the word each belongs to, in word order."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
    start = np.cumsum(length) - length
    rank = np.arange(len(codes)) - start[owner]
    powers = np.cumprod(np.full(int(length.max(initial=1)) + 1, _BASE, np.uint64))
    whole = np.add.reduceat((codes + np.uint64(1)) * powers[rank], start) if len(words) else np.zeros(0, np.uint64)
    buckets, owners = [_bucket(whole * np.uint64(0x9E3779B97F4A7C15))], [np.arange(len(words), dtype=np.int32)]
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        rolling = rolling[: len(codes) - n + 1] * _BASE + codes[n - 1 :] if n > 1 else codes.copy()
        if n in SIZES:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            buckets.append(_bucket(rolling[inside] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)))
            owners.append(owner[: len(rolling)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], owners[order]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def _weights(words: list[str]) -> list[tuple[str, float]]:
    """Distinct words and their weights, which sum to 1: 1 + log(count), so that repeats of a word count little."""
    counts = Counter(words)
    raw = [1.0 + math.log(c) if c > 1 else 1.0 for c in counts.values()]
    whole = sum(raw)
    return [(w, r / whole) for w, r in zip(counts, raw, strict=True)]


class ToxicityModel:
    """One number per n-gram bucket and a bias: the softmax of the averaged vectors, folded."""

    def __init__(self, numbers: np.ndarray, bias: float):
        self.numbers, self.bias = numbers, bias

    def word_numbers(self, words: list[str]) -> np.ndarray:
        buckets, owner = features(words)
        return np.bincount(owner, self.numbers[buckets], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)

    def score(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Probability per text; a text without words gets the bias alone."""
        found = [words_of(t) for t in texts]
        if len(cache) > CACHE:
            cache.clear()
        new = list({w for words in found for w in words if w not in cache})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            cache.update(zip(part, self.word_numbers(part).tolist(), strict=True))
        means = np.array([sum(cache[w] * r for w, r in _weights(words)) for words in found])
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -700, 700)))


def fit_texts(texts: list[str | None], labels: list[int], share: float | None = None, rounds: int = ROUNDS) -> ToxicityModel:
    """Trains vectors and softmax together. ``share``: of label 1 among all rows (default: among these)."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), (1 if len(y) and y[0] else -1) * 10.0)
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    vocabulary: dict[str, int] = {}
    docs, ids, n = [], [], []
    for d, text in enumerate(texts):
        for w, share_of_text in _weights(words_of(text)):
            docs.append(d)
            ids.append(vocabulary.setdefault(w, len(vocabulary)))
            n.append(share_of_text)
    docs, ids, n = np.array(docs, np.int32), np.array(ids, np.int32), np.array(n, np.float32)
    buckets, owner = features(list(vocabulary))
    per_word = (1 / np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1)).astype(np.float32)
    met = np.bincount(buckets, np.bincount(ids, minlength=len(vocabulary))[owner], BUCKETS)
    buckets, owner = buckets[met[buckets] >= LEAST_MET], owner[met[buckets] >= LEAST_MET]
    used, bucket_of = np.unique(buckets, return_inverse=True)
    if not len(used):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share) - np.log(1 - share)))
    bucket_of = bucket_of.astype(np.int32)
    by_word, by_bucket = np.argsort(ids, kind="stable").astype(np.int32), np.argsort(bucket_of, kind="stable").astype(np.int32)
    word_starts, bucket_starts, feature_starts = _starts(ids[by_word]), _starts(bucket_of[by_bucket]), _starts(owner)
    doc_starts, with_words, with_features = _starts(docs), np.unique(docs), np.unique(owner)
    owner_by_bucket, docs_by_word, n_by_word = owner[by_bucket], docs[by_word], n[by_word]

    random = np.random.default_rng(_SEED)
    vectors = random.normal(0, 0.1, (DIMENSIONS, len(used))).astype(np.float32)  # one row per dimension
    softmax, bias = random.normal(0, 0.5, (2, DIMENSIONS)), np.log([1 - share, share])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for step in range(1, rounds + 1):
        words = np.zeros((DIMENSIONS, len(vocabulary)), np.float32)
        for k in range(DIMENSIONS):
            words[k, with_features] = np.add.reduceat(vectors[k][bucket_of], feature_starts) * per_word[with_features]
        hidden = np.zeros((DIMENSIONS, len(y)), np.float32)
        for k in range(DIMENSIONS):
            hidden[k, with_words] = np.add.reduceat(words[k][ids] * n, doc_starts)
        logits = softmax @ hidden + bias[:, None]
        p = np.exp(logits - logits.max(axis=0))
        p /= p.sum(axis=0)
        error = p
        error[y, np.arange(len(y))] -= 1
        error *= weight
        back = (softmax.T @ error).astype(np.float32)
        gradient = np.empty_like(vectors)
        for k in range(DIMENSIONS):
            to_words = np.add.reduceat(back[k][docs_by_word] * n_by_word, word_starts) * per_word
            gradient[k] = np.add.reduceat(to_words[owner_by_bucket], bucket_starts)
        for value, slope, (mean, square) in zip((vectors, softmax, bias), (gradient, error @ hidden.T, error.sum(axis=1)), state, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            rate, damping = (RATE, DAMPING / np.bincount(y).min()) if value is vectors else (SOFTMAX_RATE, 1e-8)
            value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + damping)
    numbers = np.zeros(BUCKETS, np.float32)
    numbers[used] = (softmax[1] - softmax[0]) @ vectors
    return ToxicityModel(numbers, float(bias[1] - bias[0]))


def _starts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(sorted_ids, prepend=-1)) if len(sorted_ids) else np.zeros(0, int)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: dict[int, int] | None = None) -> ToxicityModel:
    """Fits on about as many labelled documents of labels 0 and 1 as ``per_class`` says (default ``TRAIN``), in hash order of the key.

    Other labels are left out. The sampled keys (at most twice those numbers) are broadcast, so texts are read
    by a filter and not shuffled.
    """
    per_class = per_class or TRAIN
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = hash_sample(known, "label", "key", per_class)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    rows = sorted(found.limit(2 * sum(per_class.values())).collect(), key=lambda r: (r["key"], r["label"], r["text"] or ""))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_texts([r["text"] for r in rows], [r["label"] for r in rows], share)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` (0 to 1); null and empty texts are scored as texts without words."""
    docs = docs.drop("score")
    out = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.numbers, model.bias))  # one number per bucket

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = ToxicityModel(*shared.value), {}
        for batch in slices(batches, 256):
            found = own.score(batch.column(at).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(rows, out)
