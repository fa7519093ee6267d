"""Merkle manifests, prefix fingerprints and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import merkle, prefix_hash, queries, repair, sha256
from tests.llm.conftest import prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- manifests ----


def test_states_resume_anywhere():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    words = sha256.from_bytes(b"".join(digests))
    state = sha256.initial(9)
    sha256.absorb_where(state, words, np.ones(9, bool))
    copy = state.copy()
    sha256.absorb_where(state, words, np.arange(9) % 2 == 0)
    assert sha256.to_hex(sha256.finish(copy, np.ones(9))) == [h(d.hex()) for d in digests]
    assert sha256.to_hex(sha256.finish(state, 2 - np.arange(9) % 2)) == [h(d.hex() * (2 - i % 2)) for i, d in enumerate(digests)]
    assert sha256.to_hex(sha256.finish(sha256.initial(1), np.zeros(1))) == [h()]


def plain_tree(level):
    """Levels of a tree, leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, at):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def plain_manifest(docs):
    def leaf(d, text):
        fields = (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append((d["doc_id"], leaf(d, d["text"]), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = plain_tree([r[1] for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    for g_at, g in enumerate(names):
        for at, (key, own, d) in enumerate(groups[g]):
            text, folded, proof = d["text"], own, []
            if text is not None and zlib.crc32(("" if key is None else str(key)).encode()) % 3 == 0:
                folded = leaf(d, re.sub("[A-Z]", lambda m: m[0].lower(), text))
            for left, right in [*plain_path(trees[g], at), *plain_path(top, g_at)]:
                folded = h(*left, folded, *right)
                proof += left + right
            yield key, own, trees[g][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]


def manifest_of(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "read_table", lambda *a: docs)
    return [tuple(r) for r in queries.op11_merkle_manifest(spark, "").collect()]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_plain_trees(spark, make_docs, odd_rows, monkeypatch, levels):
    """Blocks of 8, 64 and 4,096 leaves; trees of 1 to 200 leaves, nulls, ties and repeated rows."""
    monkeypatch.setattr(merkle.build, "__defaults__", (*merkle.build.__defaults__[:-1], levels))
    rows = odd_rows + [(1000 + i, f"Text {i}", "it", "s") for i in range(200)] + [(2000, "One", "xx", "s")]
    docs = make_docs(rows)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got, want = manifest_of(spark, monkeypatch, docs), list(plain_manifest([r.asDict() for r in docs.collect()]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_of_no_row(spark, make_docs, no_docs, monkeypatch):
    assert manifest_of(spark, monkeypatch, no_docs) == []
    (row,) = manifest_of(spark, monkeypatch, make_docs([(7, "A text", None, None)]))
    assert row[1] == row[2] == row[3] and row[4] == h()


def test_manifest_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(2, "a", "x", 1, 9), (1, "b", "y", 2, 8)], "doc_id long, lang string, tree string, pos long, block long")
    rows = rows.withColumn("leaf", F.unhex(F.sha2("tree", 256))).withColumn("root", F.lit("mine"))
    found = merkle.fold(merkle.build(rows), "leaf")
    assert {(r["row"]["tree"], r["row"]["root"], r["root"] == r["folded_root"]) for r in found.collect()} == {("x", "mine", True), ("y", "mine", True)}


# ---- fingerprints ----


def test_extensions_equal_letter_by_letter(spark):
    rng, rows = random.Random(1), []
    for _ in range(150):
        a = "".join(rng.choice("aé😀") for _ in range(rng.randint(0, 40)))
        b = rng.choice([a, a[:20] + "x" + a[20:], "".join(rng.choice("ab") for _ in range(30))])
        rows.append((a, rng.randint(0, len(a)), b, rng.randint(0, len(b))))
    rows.append((None, None, None, None))
    for r in prefix_hash.common_extensions(spark.createDataFrame(rows, "a string, at_a int, b string, at_b int")).collect():
        a, i, b, j = r["a"] or "", r["at_a"] or 0, r["b"] or "", r["at_b"] or 0
        forward = backward = 0
        while i + forward < len(a) and j + forward < len(b) and a[i + forward] == b[j + forward]:
            forward += 1
        while i > backward < j and a[i - backward - 1] == b[j - backward - 1]:
            backward += 1
        assert (r["forward"], r["backward"]) == (forward, backward)


def plain_likeness(a, b):
    """Common ends of two texts, in whole strides."""
    if a == b:
        return 1.0
    stride = max(prefix_hash._stride(len(t)) for t in (a, b))
    steps = range(0, min(len(a), len(b)) + 1, stride)
    ends = max(k for k in steps if a[:k] == b[:k]) + max(k for k in steps if a[len(a) - k :] == b[len(b) - k :])
    return min(len(a), len(b), ends) / max(len(a), len(b))


def print_of(text):
    return prefix_hash.fingerprint(prefix_hash.Prefixes(prefix_hash.code_points(text)))


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_equal_plain_version(spark, odd_docs, odd_rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in prefix_hash.compare_with_next(odd_docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((k, t) for k, t, *_ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        want.append((
            key, len(text), h(edited), print_of(text).text(), print_of(edited).text(), plain_likeness(text, edited), plain_likeness(text, following),
        ))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_neighbours_of_one_and_of_no_document(make_docs, no_docs):
    assert prefix_hash.compare_with_next(no_docs).count() == 0
    (row,) = prefix_hash.compare_with_next(make_docs([(1, "abcdefgh", "en", "s")])).collect()
    assert row["edited_sha256"] == h("abcdefab") and row["near_next"] == 1.0


def test_likeness_separates_edits_from_other_texts():
    rng = random.Random(2)
    for n in (40, 400, 4000):
        a, b = prose(rng, "en", n), prose(rng, "en", n)
        middle = a[: len(a) // 2] + "something else" + a[len(a) // 2 + 10 :]
        assert prefix_hash.likeness(print_of(a), print_of(middle)) > 0.85
        assert prefix_hash.likeness(print_of(a), print_of(b)) < 0.1
        assert prefix_hash.parse(print_of(a).text()) == print_of(a)


def test_fingerprints_of_a_table(spark, odd_rows, odd_docs):
    table = odd_docs.withColumn("fingerprint", F.lit("old")).withColumn("row", F.lit(1))
    got = {(r["text"], r["fingerprint"], r["row"]) for r in prefix_hash.fingerprints(table).collect()}
    assert got == {(t, print_of(t or "").text(), 1) for _, t, *_ in odd_rows}


# ---- conversations ----

_AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_damage(rows):
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        yield from [(c, t, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, s, inserted):
        ways = [(0, "")] if i == len(rows) and s in (0, 3) else []
        if inserted < 2:
            ways.append(("I", 2, best(i, _AFTER[s], inserted + 1)))
        if i < len(rows):
            ways.append(("D", 3, best(i + 1, s, 0)))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                ways.append(("R", 2 + extra, best(i + 1, _AFTER[s], 0)))
                if (s, rows[i][2][:1]) in _KEEP:
                    ways.append(("K", extra, best(i + 1, _KEEP[s, rows[i][2][:1]], 0)))
        ways = [w if len(w) == 2 else (w[1] + w[2][0], w[0] + w[2][1]) for w in ways]
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), -1, -1):
        for s in range(4):
            best(i, s, 0)
    cost, audit = best(0, 0, 0)
    out, s, i = [], 0, 0
    for edit in audit:
        if edit == "K":
            s = _KEEP[s, rows[i][2][:1]]
            out.append(f"{rows[i][2]}:{rows[i][3]}")
        elif edit != "D":
            s = _AFTER[s]
            out.append(f"{'assistant' if s == 3 else 'user'}:{'' if edit == 'I' else rows[i][3]}")
        i += edit != "I"
    first, turns = [r[2][:1] for r in rows], [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, h("\n".join(out)),
    )


def repaired(spark, monkeypatch, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, idx int" if rows and len(rows[0]) > 4 else "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(queries, "read_table", lambda *a: table)
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, "").collect()}
    damaged = list(plain_damage(r[:4] for r in rows))
    assert got == {c: plain_repair([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    return got


@pytest.mark.parametrize("block", [4, 4096])
def test_repair_equals_recursion(spark, monkeypatch, block):
    """Nulls in every column, odd roles, repeated rows and turns, conversations of many blocks and of none left."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng, rows = random.Random(3), []
    roles = ["user", "assistant", "system", "tool", None, "", "u"]
    for c in [None, *range(25)]:
        for t in range(rng.choice([1, 2, 5, 60, 150])):
            text = rng.choice(["a.", "b", "c!", "d? \n", " ", None, "", "Hello.", "e  ", f"t{t}."])
            rows.append((c, rng.choice([None, t, t, t + 3]), rng.choice(roles), text, 1, 2))
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    found = repaired(spark, monkeypatch, [*rows, (gone, 1, "user", "Dropped.", 1, 2)])
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", h())


def test_repair_of_a_long_conversation(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Turn {t}.") for t in range(5000)]
    assert len(repaired(spark, monkeypatch, rows)[1][6]) > 4000


def test_repair_of_no_rows(spark, monkeypatch):
    assert repaired(spark, monkeypatch, []) == {}


def test_ranks_choose_the_least_text():
    """Random graphs without cycles: the least continuation by ranks equals the least of all texts."""
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 25)
        edit, target, texts = np.zeros((n, 4), np.int8), np.zeros((n, 4), np.int64), [""] * n
        for v in range(n - 2, -1, -1):
            ways = []
            for a in range(4):
                if rng.random() < 0.4:
                    edit[v, a], target[v, a] = a + 1, rng.randint(v + 1, n - 1)
                    ways.append(repair.EDITS[a] + texts[target[v, a]])
            texts[v] = min(ways, default="")
        ranked = repair.rank_paths(edit, target)
        count = repair.lengths(ranked)
        got = "".join(("." + repair.EDITS)[ranked.edit[v]] for v in repair.walk(ranked, np.arange(n), count))
        assert got == "".join(texts)
