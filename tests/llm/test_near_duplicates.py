"""SimHash and embedding near-duplicates against brute force, and components against union-find."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loanlens.llm import components as C
from loanlens.llm import embedding_dedup as E
from loanlens.llm import simhash as S


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(i, (i * 7) % 90) for i in range(90)], [(5, 5), (1, 2), (2, 1), (1, 2)],
])
def test_components(spark, edges):
    rows = C.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))


def plain_fingerprint(text, width=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in ("", None, "One", "A b", "É A b c d", "a b c a b c a b c", "x\x1cy z\tq\x0bw  r\n", "a\xa0b c d"):
        assert S.fingerprint((text or "").encode()) == plain_fingerprint(text)


def near(a, b, n):
    return bin(a ^ b).count("1") <= n


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_links_connect_all_near_fingerprints(spark, distance, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 40)
    monkeypatch.setattr(S, "PAIRS", 500)
    rng, fps = random.Random(distance), set()
    for _ in range(60):
        base = rng.getrandbits(64) & rng.getrandbits(64)
        for _ in range(6):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            fps.add(base)
    for _ in range(100):  # a crowded bucket: these differ in eight bits only
        fps.add(0xABCDEF << 8 | rng.getrandbits(8))
    fps |= {0, 1, (1 << 64) - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp long"), distance).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]
    assert all(near(a, b, 64) for a, b in pairs)
    every = sorted(fps)
    want = roots(fps, [(a, b) for i, a in enumerate(every) for b in every[:i] if near(a, b, distance)])
    assert roots(fps, pairs) == want


@pytest.mark.parametrize("layout", S.LAYOUTS)
def test_thresholds_obey_the_pigeonhole_sum(layout):
    rng = np.random.default_rng(0)
    near_counts = rng.random((4, 4, 1 << 16)).astype(np.float32)
    plan = S.Plan([list(range(16 * i, 16 * i + 16)) for i in range(4)], near_counts, 1000, layout, 3)
    fps = rng.integers(-(1 << 62), 1 << 62, 50)
    limits, cost = plan.thresholds(fps)
    assert (limits.sum(axis=0) == 3 - len(layout) + 1).all() and (limits >= -1).all() and np.isfinite(cost).all()


def test_simhash_groups_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = S.simhash_groups(odd_docs.withColumn("fp", F.lit(1)).withColumn("key", F.lit("x"))).collect()
    fps = sorted((str(r["doc_id"]), r["fingerprint"]) for r in got)
    assert fps == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t, _, _ in odd_rows)
    values = {plain_fingerprint(t) for _, t, _, _ in odd_rows}
    ordered = sorted(values)
    want = roots(values, [(a, b) for i, a in enumerate(ordered) for b in ordered[:i] if near(a, b, 3)])
    low = {}
    for i, t, _, _ in odd_rows:
        r = want[plain_fingerprint(t)]
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    assert all(r["component_id"] == low[want[int(r["fingerprint"], 16)]] for r in got)
    assert S.simhash_groups(no_docs).count() == 0


def vectors(rng, n, d):
    x = rng.standard_normal((n, d)).astype(np.float32)
    for i in range(0, n // 2, 2):  # pairs just above and below the threshold
        noise = rng.standard_normal(d)
        noise -= noise @ x[i] / (x[i] @ x[i]) * x[i]
        c = 0.88 + 0.11 * rng.random()
        x[i + 1] = c * x[i] / np.linalg.norm(x[i]) + (1 - c * c) ** 0.5 * noise / np.linalg.norm(noise)
    return x


def test_embedding_links_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(E, "MEMBERS", 100)
    monkeypatch.setattr(E, "QUERIES", 300)
    x = vectors(np.random.default_rng(3), 1500, 24)
    x[700:740] = x[700]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in E.near_duplicates(rows).collect()}
    y = x.astype(float)
    close = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1)) >= 0.9
    np.fill_diagonal(close, False)
    found, true = np.array([got[i]["n_links"] for i in range(len(x))]), close.sum(axis=1)
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    assert all(got[i]["component_id"] == 700 and got[i]["n_links"] >= 39 for i in range(700, 740))
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def brute(x):
    size = np.linalg.norm(x, axis=1)
    close = (x @ x.T) / np.outer(size, size) >= 0.9
    np.fill_diagonal(close, False)
    return close


def test_embeddings_of_several_lengths(spark):
    rng, rows, links = np.random.default_rng(8), [], {}
    for d, n in ((8, 60), (5, 12), (3, 2), (2, 1)):
        x = rng.standard_normal((n, d))
        x[: n // 2] = x[0] + 0.01 * rng.standard_normal((n // 2, d))
        x[n // 2 - 1] = 3 * x[0]
        links.update({len(rows) + i: int(c) for i, c in enumerate(brute(x).sum(axis=1))})
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == links


def test_links_of_a_large_group_are_counted_not_listed(spark, monkeypatch):
    monkeypatch.setattr(E, "MEMBERS", 400)
    monkeypatch.setattr(E, "QUERIES", 900)
    rng, n = np.random.default_rng(4), 3000
    x = rng.standard_normal(32) + 0.05 * rng.standard_normal((n, 32))
    x = np.concatenate([x, rng.standard_normal((500, 32))])
    close = brute(x)
    classes = spark.createDataFrame([(i, 1 + i % 3, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "id long, n long, vec binary")
    rows = E.class_links(classes, E.fit_index(classes, 0.9, "<f8"), 0.9, "<f8").collect()
    counts = np.zeros(len(x), int)
    for r in rows:
        if r["b"] is None:
            counts[r["a"]] += r["n"]
    want = close @ (1 + np.arange(len(x)) % 3)
    assert len(rows) < 200 * n and (counts[:n] <= want[:n]).all() and counts.sum() >= 0.97 * want.sum()
    assert len(set(map(int, roots(range(n), [(r["a"], r["b"]) for r in rows if r["b"] is not None and r["a"] < n and r["b"] < n]).values()))) == 1


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [1.0]), (0, [1.0, 0.0]), (None, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = [(str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and all(kept == (key == str(low)) for key, _, low, kept in got if key != "None")
    assert {g[:3] for g in got} == {("0", 2, 0), ("1", 2, 0), *((str(i), 0, i) for i in range(2, 8)), ("8", 1, 8), ("9", 1, 8), ("None", 0, None)}
    assert E.near_duplicates(docs.limit(0)).count() == 0
