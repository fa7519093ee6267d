"""Token files, packing, mixing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loanlens.llm import mixing, packing, token_store, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    """The library as it is."""
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODERS = {p: (tokens.Encoder(p), plain(p)) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@given(text=st.one_of(st.text(max_size=60), st.text("aB é'stß.\n \t\xa0\x1c 1,-", max_size=40)))
@settings(max_examples=300, deadline=None)
def test_ids_by_chunks_are_those_of_the_whole_text(path, text):
    own, whole = ENCODERS[path]
    assert np.frombuffer(own.encode(text), "<u4").tolist() == whole(text)


def test_what_an_encoder_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 10)
    own = tokens.Encoder(BYTE)
    text = " ".join(f"w{i}" for i in range(100))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == plain(BYTE)(text) and len(own.chunks) <= 10 and len(own.spaced) <= 10


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**31, 2**32 - 1])
def test_token_file_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(3000) ** 4 * top).astype(np.uint32)
    ends = np.array([0, 700, 700, 3000])
    got = token_store.TokenFile(token_store.to_file([None, 5, -3, 1 << 60], ends, ids))
    assert got.keys == [None, 5, -3, 1 << 60] and np.array_equal(got.tokens(), ids)
    for i in [0, 1, 511, 512, 513, 2999, *rng.integers(0, 3000, 60).tolist()]:
        assert got.token(i) == ids[i]
    assert got.document(0) == [] and got.document(1) == ids[:700].tolist()
    with pytest.raises(IndexError):
        got.token(3000)


def test_empty_token_file():
    got = token_store.TokenFile(token_store.to_file([1], np.array([0]), np.zeros(0, np.uint32)))
    assert len(got) == 0 and got.tokens().tolist() == []


def test_token_store_reads_back_every_document(spark, odd_docs, odd_rows, no_docs):
    files = token_store.write(odd_docs.withColumn("key", F.lit(1)).withColumn("ids", F.lit(2)), WORD, 2, file_tokens=2000)
    assert files.count() > 1
    got = sorted(token_store.read(spark, files).collect(), key=lambda r: r["start"])
    want = sorted((i is not None, i or 0, t is not None, t or "") for i, t, _, _ in odd_rows)
    at, encode = 0, ENCODERS[WORD][1]
    assert len(got) == len(want)
    for r, (known, i, _, t) in zip(got, want, strict=True):
        ids = [*encode(t), 2]
        assert (r["key"], r["start"], r["n_tokens"]) == (i if known else None, at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert token_store.read(spark, token_store.write(no_docs, WORD, 2)).count() == 0


def check_packed(rows, docs, length):
    whole = Counter()
    pieces, sequences = {}, {}
    for i, t in docs:
        whole[i, zlib.crc32(np.array([*ENCODERS[BYTE][1](t), 1], "<u4").tobytes())] += 1
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        assert sum(r["length"] for r in own) <= length
    got = Counter()
    for i, own in pieces.items():
        if sum(n for (k, _), n in whole.items() if k == i) == 1:
            own.sort(key=lambda r: r["start"])
            got[i, zlib.crc32(b"".join(bytes(r["ids"]) for r in own))] += 1
            assert own[0]["doc_tokens"] == sum(r["length"] for r in own)
    single = Counter({k: n for k, n in whole.items() if sum(m for (i, _), m in whole.items() if i == k[0]) == 1})
    assert got == single
    assert sum(r["length"] for r in rows) == sum(len(ENCODERS[BYTE][1](t)) + 1 for _, t in docs)
    return len(sequences)


@pytest.mark.parametrize("length,windows", [(64, 3), (2048, 64)])
def test_packing_places_every_id_once(spark, odd_docs, odd_rows, length, windows, monkeypatch):
    monkeypatch.setattr(packing, "MERGED_TASKS", 2)
    rows = packing.pack(odd_docs.repartition(5).withColumn("key", F.lit(0)), BYTE, 1, length=length, windows=windows).collect()
    n = check_packed(rows, [(i, t) for i, t, _, _ in odd_rows], length)
    total = sum(r["length"] for r in rows)
    assert n * length - total <= 0.06 * total + 3 * length


def test_packer_is_best_fit_and_bounded():
    p = packing.Packer(length=10, windows=2, least_cut=3)
    for size in (6, 7, 3):
        p.add(size, b"\0" * 4 * size)
    assert [sum(len(x[3]) // 4 for x in w) for w in p.done] == [10]  # 7 + 3, the closest fit
    p.add(8, b"\0" * 32)
    p.add(9, b"\0" * 36)  # fits nowhere: the window with 2 free is emitted as it is
    assert len(p.open) <= 2 and [sum(len(x[3]) // 4 for x in w) for w in p.done] == [10, 8]


def test_packing_an_empty_table(no_docs):
    assert packing.pack(no_docs, BYTE, 1).count() == 0


def test_temperature_meets_its_targets():
    totals = [1_000_000, 50_000, 50_000, 20_000]
    budget = sum(totals)
    x = mixing.temperature(totals, budget, entropy=0.9, repeats=100)
    assert mixing.entropy_share(totals, x) == pytest.approx(0.9, abs=1e-6)
    x = mixing.temperature(totals, budget, entropy=0.99, repeats=3)
    assert max(budget * w / t for w, t in zip(mixing.tempered(totals, x), totals, strict=True)) == pytest.approx(3, abs=1e-6)
    assert mixing.temperature([10, 10], 20) == 1.0 and mixing.temperature([5], 5) == 1.0


def test_mix_deals_parts_of_whole_passes(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(4)
    docs = make_docs([(i, "w " * rng.randint(1, 40), "en", "big" if i % 20 else "small") for i in range(2000)])
    rows = mixing.mix(docs.withColumn("part", F.lit("x")).withColumn("weight", F.lit(0)), entropy=0.8).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    total = sum(len(r["text"].split()) for r in docs.collect())
    assert sum(own[0]["weight"] for own in sources.values()) == pytest.approx(1)
    for own in sources.values():
        own.sort(key=lambda r: r["start"])
        starts = np.cumsum([0, *[r["n_tokens"] for r in own]])
        assert [r["start"] for r in own] == starts[:-1].tolist()
        part = own[0]["part"]
        assert part == int(total * own[0]["weight"]) and starts[-2] < part <= starts[-1] + 0
        epochs = [r["epoch"] for r in own]
        assert epochs == sorted(epochs)
        for e in range(max(epochs)):
            assert len({r["doc_id"] for r in own if r["epoch"] == e}) == sum(x == e for x in epochs)
    first = [r["doc_id"] for r in sources["small"] if r["epoch"] == 0]
    assert first != sorted(first) and first != [r["doc_id"] for r in sources["small"] if r["epoch"] == 1]
    assert mixing.mix(odd_docs).count() > 0 and mixing.mix(no_docs).count() == 0


def test_stages_on_odd_rows(spark, odd_docs, odd_rows):
    docs = odd_docs.withColumn("row", F.lit("a")).withColumn("name", F.lit("b")).withColumn("score", F.lit(1)).withColumn("secrets", F.lit("z"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "name", "score", "secrets"]
        seen[name] = docs.collect()
    texts = [(i, t) for i, t, _, _ in odd_rows if any(map(str.isalpha, t or ""))]
    assert len(seen["language_id"]) == len(texts) and all(r["lang"] for r in seen["language_id"])
    kept = [r["doc_id"] for r in seen["simhash_dedup"]]
    assert len(kept) == len(set(kept)) + (kept.count(107) - 1) and 104 not in kept and 105 not in kept and 0 in kept and 103 in kept
    assert len(seen["secret_scan"]) == len(kept)
    assert {r["doc_id"] for r in seen["mix_sources"]} <= set(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(p["length"] for p in pieces) == sum(len(ENCODERS[BYTE][1](r["text"])) + 1 for r in seen["mix_sources"])


def test_secrets_are_replaced(spark, make_docs):
    docs = make_docs([(1, "a token=abcdefghijklmnop b", "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secret_scan_stage(spark, docs, "").collect()}
    assert got == {1: ("a [assign] b", 12), 2: ("clean", 5), 3: (None, None)}


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_on_an_empty_table(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0
