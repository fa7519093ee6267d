"""Language ID and toxicity."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from loanlens.llm import langid, toxicity


@pytest.fixture(scope="module")
def tiny():
    counts = {"a": Counter({"ab": 5, "abc": 2, "b": 3}), "b": Counter({"cc": 4, "cab": 1})}
    return langid.fit_counts(counts, ["a", "b", "c", "ab", "bc", "▁", "▁a", "▁ab", "cc"])


def test_forward_sums_all_segmentations(tiny):
    pieces = ["a", "b", "c", "ab", "bc", "▁", "▁a", "▁ab", "cc"]
    for word in ("abc", "ccab", "b", "zab", "abcabcabcabcabcabcabc"[:9]):
        marked = "▁" + word
        for g in range(2):
            p = {x: tiny.probability[i, g] for i, x in enumerate(pieces)}
            total = 0.0
            for k in range(len(marked)):
                for cuts in combinations(range(1, len(marked)), k):
                    parts = [marked[a:b] for a, b in zip((0, *cuts), (*cuts, len(marked)), strict=True)]
                    value = 1.0
                    for x in parts:
                        value *= p.get(x, tiny.probability[len(pieces), g] if len(x) == 1 else 0.0)
                    total += value
            assert tiny.word_scores([word])[0, g] == pytest.approx(np.log(total))


def test_probabilities_sum_to_one_and_very_long_words_score(tiny):
    assert np.allclose(tiny.probability.sum(axis=0), 1)
    assert np.isfinite(tiny.word_scores(["abc" * 4000])).all()


def _segmentations(marked, pieces):
    """Piece lists that spell ``marked``; single characters that are no piece are None."""
    if not marked:
        yield []
    for k in range(1, len(marked) + 1):
        if marked[:k] in pieces or k == 1:
            for rest in _segmentations(marked[k:], pieces):
                yield [marked[:k] if marked[:k] in pieces else None, *rest]


def test_a_round_of_fitting_equals_enumeration():
    """Long pieces included: nothing bounds their length."""
    pieces = ["a", "b", "▁", "ab", "ba", "▁ab", "▁abababababab", "bababababa"]
    words = {"abababababab": 3, "abba": 2, "zb": 1}
    got = langid.fit_counts({"x": Counter(words)}, pieces, rounds=1).probability[:, 0]
    expected = np.zeros(len(pieces) + 2)
    for word, n in words.items():
        ways = list(_segmentations("▁" + word, set(pieces)))
        odds = np.array([(1 / (len(pieces) + 1)) ** len(w) for w in ways])
        for w, share in zip(ways, odds / odds.sum(), strict=True):
            for x in w:
                expected[len(pieces) if x is None else pieces.index(x)] += n * share
    expected[:-1] += 0.01
    assert got == pytest.approx(expected / expected.sum())


def test_very_long_words_are_fitted():
    model = langid.fit_counts({"x": Counter({"ab" * 2000: 1, "c": 1})}, ["a", "b", "▁", "ab", "c", "▁c"])
    assert np.isfinite(model.probability).all() and model.probability[:, 0].sum() == pytest.approx(1)
    assert model.probability[3, 0] > 0.9


def test_unlearned_languages_and_gibberish_are_unknown(spark, make_docs):
    import corpus_pipeline

    rng = random.Random(4)
    learned = [(i, prose(rng, lang, 100), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    mixed = [(200 + i, prose(rng, "en", 60) + " " + prose(rng, "de", 60), None, "s") for i in range(10)]
    short = [(300, "xkcd zzt", None, "s"), (301, prose(rng, "de", 8), None, "s"), (302, "xkcd zzt " * 200, None, "s")]
    random_letters = [
        (400 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(80)), "fr", "s")
        for i in range(5)
    ]
    finnish_more = "Toiseksi eniten sitä kuulee naapurimaissa, joissa vanhemmat opettavat kieltä lapsilleen yhdessä koulujen kanssa."
    cyrillic = "это длинный текст на другом языке, который записан другими буквами, и ни одно слово его не встречалось раньше; " + (
        "поэтому вероятность каждого слова очень мала, какой бы язык из известных мы ни выбрали для сравнения с этим отрывком"
    )
    finnish = "Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään, ja sitä puhuvat pääosin suomalaiset. "
    other = [(500, finnish + finnish_more, "en", "s"), (501, cyrillic, None, "s")]
    model = langid.fit(make_docs(learned[:90]))
    rows = learned + mixed + short + random_letters + other
    known = {r["doc_id"]: r["known"] for r in langid.identify(make_docs(rows), model).collect()}
    assert all(known[r[0]] for r in learned + mixed)
    assert [known[r[0]] for r in random_letters + other] == [False] * 7
    assert known[300] is None and known[302] is None  # too few distinct words to tell
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, make_docs(learned + mixed + short + other), "").collect()}
    assert kept >= {r[0] for r in learned + mixed} and not kept & {501}


def test_held_out_accuracy(make_docs, odd_docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 40), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    model = langid.fit(make_docs(rows[:90]))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make_docs(rows[90:]), model).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows[90:]) >= 29
    odd = langid.identify(odd_docs.withColumn("score", F.lit("mine")), model)
    rows = odd.collect()
    assert len(rows) == odd_docs.count() and odd.columns[-3:] == ["lang_pred", "score", "known"]
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_of_empty_tables(no_docs, odd_docs):
    model = langid.fit(no_docs)
    assert langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, model).collect()} == {"und"}


def test_toxicity_learns_and_generalises_to_misspellings(make_docs, spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, "en", 60).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vileperson"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 3 == 0)))
    docs, known = make_docs(rows), spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id is null or doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels[200:]) >= 97
    fresh = [prose(rng, "en", 60) for _ in range(20)]
    clean, misspelt = (model.score([t + extra for t in fresh], {}) for extra in ("", " nastywordd nasttyword vileperrson"))
    assert (clean < 0.5).sum() >= 18 and (misspelt >= 0.5).sum() >= 18
    odd = toxicity.score(odd_docs.withColumn("score", F.lit(9)), model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_without_training_data(no_docs, spark):
    model = toxicity.fit(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(["any", None], {}).max() < 0.5


def test_word_bags_are_means():
    buckets, owner = toxicity.features(["ab", "xyz"])
    assert list(np.bincount(owner)) == [1 + 2 + 1, 1 + 3 + 2 + 1]
    model = toxicity.ToxicityModel(np.arange(toxicity.BUCKETS, dtype=np.float32), 0.0)
    assert model.word_numbers(["ab"])[0] == pytest.approx(buckets[owner == 0].mean())


def _plain_training(texts, labels, rounds):
    """The same training by loops over documents, words and n-grams, in double precision."""
    bags = []  # per text: {bucket: share of its mean}
    for text in texts:
        bag = Counter()
        for word, share in toxicity._weights(toxicity.words_of(text)):
            grams = toxicity.features([word])[0].tolist()
            for g in grams:
                bag[g] += share / len(grams)
        bags.append(bag)
    used = sorted({g for bag in bags for g in bag})
    share = sum(labels) / len(labels)
    random_numbers = np.random.default_rng(toxicity._SEED)
    start = random_numbers.normal(0, 0.1, (toxicity.DIMENSIONS, len(used)))
    vector = {g: start[:, i].copy() for i, g in enumerate(used)}
    softmax, bias = random_numbers.normal(0, 0.5, (2, toxicity.DIMENSIONS)), np.log([1 - share, share])
    first, second = {}, {}

    def step(name, value, slope, rate, damping, turn):
        first[name] = 0.9 * first.get(name, 0) + 0.1 * slope
        second[name] = 0.99 * second.get(name, 0) + 0.01 * slope**2
        return value - rate * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + damping)

    damping = toxicity.DAMPING / min(labels.count(0), labels.count(1))
    for turn in range(1, rounds + 1):
        to_vector, to_softmax, to_bias = {g: np.zeros(toxicity.DIMENSIONS) for g in used}, np.zeros_like(softmax), np.zeros(2)
        for bag, label in zip(bags, labels, strict=True):
            hidden = sum((w * vector[g] for g, w in bag.items()), np.zeros(toxicity.DIMENSIONS))
            odds = np.exp(softmax @ hidden + bias)
            error = (odds / odds.sum() - np.eye(2)[label]) / len(labels)
            to_softmax += np.outer(error, hidden)
            to_bias += error
            for g, w in bag.items():
                to_vector[g] += w * (softmax.T @ error)
        vector = {g: step(g, v, to_vector[g], toxicity.RATE, damping, turn) for g, v in vector.items()}
        softmax = step("softmax", softmax, to_softmax, toxicity.SOFTMAX_RATE, 1e-8, turn)
        bias = step("bias", bias, to_bias, toxicity.SOFTMAX_RATE, 1e-8, turn)
    scores = []
    for bag in bags:
        odds = np.exp(softmax @ sum((w * vector[g] for g, w in bag.items()), np.zeros(toxicity.DIMENSIONS)) + bias)
        scores.append(odds[1] / odds.sum())
    return scores


@pytest.mark.parametrize("rounds", [1, 4])
def test_training_equals_plain_loops(monkeypatch, rounds):
    monkeypatch.setattr(toxicity, "LEAST_MET", 1)
    texts = ["you vile vile thing", "a calm day, a calm sea", "vilest words", "", "calm words on the sea", "thing of the day"]
    labels = [1, 0, 1, 0, 0, 0]
    got = toxicity.fit_texts(texts, labels, rounds=rounds).score(texts, {})
    assert got == pytest.approx(_plain_training(texts, labels, rounds), rel=2e-3)
