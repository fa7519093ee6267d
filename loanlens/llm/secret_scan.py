"""Secret scans through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must hold. The
index lists, for each trigram that some query names, the documents with it; a rule's candidates come from
intersecting those lists, and only candidates are verified by the expression. A rule without a mandatory
trigram has every document as a candidate. All work on rows is done by built-in functions.
"""

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre  # parse tree of Python's own parser
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.session import materialize

#: More alternatives of a literal than this are not enumerated; the part then names no trigram.
MAX_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java and Python. A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further public key formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,99}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def _literals(tree) -> list[list[set[str] | None]]:
    """A pattern as alternatives of sequences; each element holds the strings possible there, None: anything."""
    out: list[list[set[str] | None]] = [[]]
    for op, arg in tree:
        if op is sre.LITERAL:
            parts = [[{chr(arg).lower()}]]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            parts = [[{chr(a).lower() for _, a in arg}]]
        elif op is sre.SUBPATTERN:
            parts = _literals(arg[-1])
        elif op is sre.BRANCH:
            parts = [p for branch in arg[1] for p in _literals(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] == 1 and arg[0] == 0:
            parts = [[], *_literals(arg[2])]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            parts = [[*p * min(arg[0], 3), *([None] if arg[1] != arg[0] or arg[0] > 3 else [])] for p in _literals(arg[2])]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            parts = [[]]
        else:
            parts = [[None]]
        out = [a + b for a, b in product(out, parts)]
        if len(out) > MAX_LITERALS:
            return [[None]]
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams that every match of the pattern holds (lower-cased), or None if there are none.

    A text can match only if it holds all trigrams of one alternative.
    """
    found = set()
    for sequence in _literals(_parser.parse(pattern)):
        options: list[frozenset[str]] = [frozenset()]
        run: list[set[str]] = []
        for part in [*sequence, None]:
            if part is not None and len(part) <= 8:
                run.append(part)
                continue
            strings = {""}
            for letters in run:
                strings = {s + c for s in strings for c in letters}
                if len(strings) > MAX_LITERALS:
                    strings = {""}
            run = []
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            if frozenset() not in grams:
                options = [a | b for a in options for b in grams][:] if len(options) * len(grams) <= MAX_LITERALS else options
        found.update(options)
    if not found or frozenset() in found:
        return None
    return sorted(sorted(o) for o in found if not any(other < o for other in found))


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: one row ``(trigram, key)`` per trigram of the list and row that holds it (ASCII case ignored)."""
    lowered = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select(F.explode(present).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and the kinds of the rules whose Boolean query it satisfies; rules without a query are not listed."""
    spark = index.sparkSession
    clauses = [
        (r.kind, at, position, gram, (1 << len(grams)) - 1)
        for r in rules
        for at, grams in enumerate(trigram_query(r.pattern) or [])
        for position, gram in enumerate(grams)
    ]
    if not clauses:
        return index.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    table = spark.createDataFrame(clauses, "kind string, clause int, position int, trigram string, whole long")
    met = (
        index.join(F.broadcast(table), "trigram")  # bounded by the rules' text
        .groupBy("key", "kind", "clause", "whole")
        .agg(F.bit_or(F.expr("shiftleft(1L, position)")).alias("seen"))
        .where("seen = whole")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of the rule's matches as structs, in code points; positions come from the text between the matches."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(whole, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), F.transform(counted, F.length).alias("counted"))
    kind = "struct<start:int,place:int,end:int,kind:string>"
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["length"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(x["counted"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row and column of ``docs`` with ``secrets``: its spans ``(start, place, end, kind)``, sorted.

    Starts and ends are code points, ends exclusive; ``place`` is the rule's position. Matches are leftmost and
    do not overlap within a rule. Null and empty texts have no spans; rows with equal or null keys are
    scanned each by its own text. A column named ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() if q for grams in q for g in grams})
    index = materialize(postings(docs, grams, key, text), "postings") if grams else None
    listed = docs
    if index is not None:
        found = candidates(index, rules).select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds")).hint("shuffle_hash")
        listed = docs.join(found, docs[key].eqNullSafe(found["_key"]), "left").drop("_key")
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    own = []
    for place, rule in enumerate(rules):
        # A full scan first asks for a match that counts, where the expression allows to say so.
        wanted = F.array_contains("_kinds", rule.kind) if queries[rule.kind] else body.rlike(_counting(rule))
        own.append(F.when(wanted, _spans(body, rule, place)).otherwise(empty))
    result = listed.withColumn("secrets", F.sort_array(F.concat(*own)))
    return result.drop("_kinds") if index is not None else result


def _counting(rule: Rule) -> str:
    """The pattern of a match that counts: a trailing ``+`` is replaced by the least length."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; a span that begins inside an earlier one is covered by it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
