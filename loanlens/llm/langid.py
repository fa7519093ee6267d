"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities for the pieces of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces (forward algorithm); a text's is the product over its
words. Probabilities are fitted by expectation-maximisation over the same lattice.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from loanlens.llm.common import hash_sample, slices

#: Label of texts without a letter.
UNDETERMINED = "und"
#: Labelled documents per language that a model is fitted on (whole texts).
TRAIN_PER_LANGUAGE = 300
ROUNDS = 4
#: Words whose scores a task keeps; then it starts over.
CACHE = 400_000
#: A text is unknown if its distinct words have this many letters and marks, and its familiarity is this many deviations (at least
#: ``LEAST_SPREAD`` each) below the mean of the training texts. On sf0.1 the lowest of 2,731 held-out texts is 3.2 deviations
#: of 0.046 below, ones that mix languages included; Dutch, the closest of four unlearned languages, 42, random letters over 120.
LEAST_LETTERS, DEVIATIONS, LEAST_SPREAD = 200, 12.0, 0.05
_WORDS = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_WIDTH = 64  # a block of words holds as many characters as ``rows`` words of this length
_BASE, _MIX, _SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    words = _WORDS.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-cased pieces of letters of a public sentencepiece model, without specials."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p and (p == _MARK or p.lstrip(_MARK).isalpha()) and p.count(_MARK) <= 1})


class Pieces:
    """Finds piece ids of substrings by their hashes; id ``len(pieces)`` stands for any other single character."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.size, self.longest = keys[self.order], len(pieces), max(map(len, pieces), default=1)
        slots = self._slot(keys)
        self.table = np.full(1 << _SLOTS, -1, np.int32)
        self.table[slots] = np.arange(len(keys))
        used, n = np.unique(slots, return_counts=True)
        self.table[used[n > 1]] = -2  # several pieces: search
        self.own = keys

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % (1 << 64)
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        out = self.table[self._slot(h)]
        shared = np.flatnonzero(out == -2)
        out[out >= 0] = np.where(self.own[out[out >= 0]] == h[out >= 0], out[out >= 0], -1)
        if len(shared):
            at = np.searchsorted(self.keys, h[shared]).clip(max=self.size - 1)
            out[shared] = np.where(self.keys[at] == h[shared], self.order[at], -1)
        return out

    def blocks(self, words: list[str], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, dict[tuple[int, int], np.ndarray]]]:
        """Words of similar length: their positions, lengths, and piece ids by (end, length of piece)."""
        length = np.array([len(w) + 1 for w in words])
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            own = order[at : at + rows]
            while len(own) > 1 and len(own) * length[own[-1]] > rows * _WIDTH:  # few rows where words are very long
                own = own[: len(own) // 2]
            at += len(own)
            n, width = length[own], int(length[own[-1]])
            codes = np.zeros((len(own), width), np.uint32)
            flat = np.frombuffer("".join(_MARK + words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes[np.arange(width) < n[:, None]] = flat
            codes = codes.T.astype(np.uint64)
            cells: dict[tuple[int, int], np.ndarray] = {}
            recent: list[np.ndarray] = []  # hashes of the substrings that end here, by length
            for j in range(width):
                recent = [codes[j]] + [h * _BASE + codes[j] for h in recent[: self.longest - 1]]
                for k, h in enumerate(recent):
                    ids = self.find(h)
                    if k == 0:
                        ids[ids < 0] = self.size
                    if (ids >= 0).any():
                        cells[j + 1, k + 1] = ids
            yield own, n, cells


def _forward(n: np.ndarray, cells: dict, p: np.ndarray) -> np.ndarray:
    """log-probability per word and language; ``p``: (pieces + 2, languages), the last row zero (no piece)."""
    width, longest = int(n.max()), max(k for _, k in cells)
    recent = [np.ones((len(n), p.shape[1]))]
    scale, out = np.zeros_like(recent[0]), np.zeros_like(recent[0])
    for j in range(1, width + 1):
        now = sum(recent[-k] * p[cells[j, k]] for k in range(1, min(longest, j) + 1) if (j, k) in cells)
        recent = [*recent[-longest + 1 :], now] if longest > 1 else [now]
        if j % 16 == 0:
            top = np.maximum(np.max(recent, axis=0), 1e-300)
            recent = [r / top for r in recent]
            scale += np.log(top)
            now = recent[-1]
        done = n == j
        if done.any():
            out[done] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
    return out


def _expected(n: np.ndarray, cells: dict, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of any length under one language.

    Backwards from the end, a position hands its weight to the starts of the pieces that may end there, by their
    shares of its forward probability; the shares are worked out in logarithms, so nothing underflows.
    """
    width, longest, rows = int(n.max()), max(k for _, k in cells), np.arange(len(n))
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    forward = np.full((width + 1, len(n)), -np.inf)
    forward[0] = 0
    for j in range(1, width + 1):
        for k in range(1, min(longest, j) + 1):
            if (j, k) in cells:
                forward[j] = np.logaddexp(forward[j], forward[j - k] + logs[cells[j, k]])
    own, out = np.zeros((width + 1, len(n))), np.zeros(len(p))
    own[n, rows] = weight
    for j in range(width, 0, -1):
        for k in range(1, min(longest, j) + 1):
            if (j, k) in cells:
                share = own[j] * np.exp(forward[j - k] + logs[cells[j, k]] - forward[j])
                own[j - k] += share
                np.add.at(out, cells[j, k], share)
    out[-1] = 0
    return out


class LanguageModel:
    """Piece probabilities per language over a fixed vocabulary."""

    def __init__(self, pieces: list[str], languages: list[str], probability: np.ndarray):
        self.pieces, self.languages, self.probability = Pieces(pieces), languages, probability
        #: Familiarity below which a long text is in none of the languages; ``fit`` sets it.
        self.least_familiar = -math.inf

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log-probability per word and language."""
        out = np.zeros((len(words), len(self.languages)))
        for own, n, cells in self.pieces.blocks(words):
            out[own] = _forward(n, cells, self.probability)
        return out

    def predict(self, texts: Iterable[str | None], cache: dict[str, int], scores: list[np.ndarray]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, posterior and familiarity per text. ``cache`` and ``scores`` hold words met before; both start empty.

        The familiarity is the log-probability per character (word marks included) of the distinct words, each under the language
        that it fits best, so that texts of several languages are familiar too and repeating a rare word does not
        matter. It is None below ``LEAST_LETTERS`` characters of distinct words.
        """
        found = [words_of(t) for t in texts]
        if len(cache) > CACHE:
            cache.clear()
            scores.clear()
        new = list({w for words in found for w in words if w not in cache})
        if new:
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            scores[:] = [np.concatenate([*scores, self.word_scores(new)])]
        labels, posteriors, familiar = [], [], []
        for words in found:
            if not words or not self.languages:
                labels.append(UNDETERMINED)
                posteriors.append(0.0)
                familiar.append(None)
                continue
            total = scores[0][[cache[w] for w in words]].sum(axis=0)
            distinct = set(words)
            letters = sum(map(len, distinct)) + len(distinct)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            labels.append(self.languages[best])
            posteriors.append(float(odds[best] / odds.sum()))
            familiar.append(float(scores[0][[cache[w] for w in distinct]].max(axis=1).sum() / letters) if letters >= LEAST_LETTERS else None)
        return labels, posteriors, familiar


def fit_counts(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """Expectation-maximisation per language over its word counts."""
    languages, table = sorted(counts), Pieces(pieces)
    out = np.zeros((len(pieces) + 2, len(languages)))
    for g, language in enumerate(languages):
        words = list(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        blocks = list(table.blocks(words)) if words else []
        p = np.full(len(pieces) + 2, 1.0 / (len(pieces) + 1))
        p[-1] = 0
        for _ in range(rounds):
            got = sum((_expected(n, cells, p, weight[own]) for own, n, cells in blocks), np.zeros(len(p)))
            got[:-1] += 0.01
            p = got / got.sum()
        out[:, g] = p
    return LanguageModel(pieces, languages, out)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, vocabulary_path: str | None = None) -> LanguageModel:
    """Fits on at most about ``per_language`` documents of each non-null language (hash order of the key).

    The familiarity of the same documents sets the bound of unknown texts; each is scored once all are counted.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts: dict[str, Counter] = {}
    number: dict[str, int] = {}
    texts: list[np.ndarray] = []  # numbers of the distinct words of each text
    for r in hash_sample(rows, "lang", "key", per_language).select("text", "lang").toLocalIterator():
        words = words_of(r["text"])
        counts.setdefault(r["lang"], Counter()).update(words)
        texts.append(np.array([number.setdefault(w, len(number)) for w in dict.fromkeys(words)], np.int32))
    model = fit_counts(counts, vocabulary(vocabulary_path))
    if number:
        best, letters = model.word_scores(list(number)).max(axis=1), np.array([len(w) + 1 for w in number])
        found = np.array([best[t].sum() / letters[t].sum() for t in texts if letters[t].sum() >= LEAST_LETTERS])
        if len(found):
            model.least_familiar = float(found.mean() - DEVIATIONS * max(found.std(), LEAST_SPREAD))
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score`` (posterior, 0 to 1) and ``known``.

    Texts that are null or hold no letter are ``und`` with score 0. Languages that fit equally well give the first by name.
    ``known`` is false for texts whose familiarity is below the model's bound; shorter texts and those
    without a letter have none. Repeated rows are scored alike, an empty table gives no row, texts are scored whole. Columns of
    those names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "known")
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", BooleanType())]
    out = StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed vocabulary times languages

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache, scores = shared.value, {}, []
        for batch in slices(batches, 256):
            labels, posteriors, familiar = own.predict(batch.column(at).to_pylist(), cache, scores)
            known = [None if f is None else f >= own.least_familiar for f in familiar]
            arrays = [*batch.columns, pa.array(labels, pa.string()), pa.array(posteriors, pa.float64()), pa.array(known, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "lang_pred", "score", "known"])

    return docs.mapInArrow(rows, out)
