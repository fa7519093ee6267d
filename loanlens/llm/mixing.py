"""Mixing sources to target weights by temperature.

Source shares of the tokens are raised to an exponent and normalised. The exponent is bisected: the largest
one in [0, 1] whose weights reach a target entropy (as a share of the most possible) and repeat no source
more often than a limit. A token budget is then dealt by the weights; each source fills its part from
permutations of its documents, block by block, each pass (epoch) in a new order.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import WORD
from loanlens.session import materialize

#: Share of the most possible entropy that the weights shall have, and passes over a source at most.
TARGET_ENTROPY, MAX_REPEATS = 0.9, 4.0
BISECTIONS = 40
#: Documents of a block on average; a block is ordered within one task.
BLOCK_DOCS = 512
SEED = "mix"


def entropy_share(totals: list[int], exponent: float) -> float:
    """Entropy of the tempered shares over log(sources); 1 for fewer than two sources."""
    weights = tempered(totals, exponent)
    return 1.0 if len(weights) < 2 else -sum(w * math.log(w) for w in weights) / math.log(len(weights))


def tempered(totals: list[int], exponent: float) -> list[float]:
    whole = sum(totals)
    powers = [(t / whole) ** exponent for t in totals]
    norm = sum(powers)
    return [p / norm for p in powers]


def temperature(totals: list[int], budget: int, entropy: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS) -> float:
    """The exponent. Both conditions pull apart if small sources would repeat too often; then the repetition limit wins.

    A smaller exponent raises the entropy and the passes over small sources. The entropy asks for an exponent
    of at most ``e``, the limit for one of at least ``r``; the result is ``max(e, r)``.
    """

    def bisect(holds_high) -> float:
        low, high = 0.0, 1.0
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (low, middle) if holds_high(middle) else (middle, high)
        return high

    def passes(x: float) -> float:
        return max(budget * w / t for w, t in zip(tempered(totals, x), totals, strict=True))

    by_entropy = 1.0 if entropy_share(totals, 1.0) >= entropy else bisect(lambda x: entropy_share(totals, x) < entropy)
    by_repeats = 0.0 if passes(0.0) <= repeats else bisect(lambda x: passes(x) <= repeats)
    return max(by_entropy, by_repeats)


def _md5_number(*parts: Column) -> Column:
    """A uniform number below 2^32 from the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Words of a text; the measure of a document, at least 1 so that empty texts take part."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str | None = "text", source: str = "source",
    budget: int | None = None, entropy: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, tokens: str | None = None,
) -> DataFrame:
    """One row per document and pass in which it is dealt.

    Columns: ``key``, ``source`` (null becomes the source ``''``), ``n_tokens`` (words of the text, or the column ``tokens``),
    ``epoch``, ``block``, ``start`` (tokens of the source dealt before it, over all passes), ``weight`` and ``part``
    (tokens the source shall fill). A document is dealt if its start lies
    below the source's part of the budget (default: all tokens), so a part is met to within one document.
    Blocks are hashes of the key; rows with equal keys keep their count. Order within a pass: block, then
    hash. Sources are collected, one total each; documents are not. An empty table gives no rows.
    """
    size = token_count(F.col(text)) if tokens is None else F.col(tokens).cast("long")
    rows = materialize(docs.select(F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"), size.alias("n_tokens")), "sizes")
    found = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("docs")).orderBy("source").collect()
    totals = [r["total"] for r in found]
    if not totals:
        return rows.select(
            F.col("key").alias(key), "source", "n_tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"),
            F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("part"),
        ).limit(0)
    budget = sum(totals) if budget is None else budget
    weights = tempered(totals, temperature(totals, budget, entropy, repeats))
    parts = [
        (r["source"], round(w, 9), r["total"], int(budget * round(w, 9)), max(1, -(-r["docs"] // BLOCK_DOCS)))
        for r, w in zip(found, weights, strict=True)
    ]
    plan = rows.sparkSession.createDataFrame(parts, "source string, weight double, total long, part long, blocks long")
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    last = F.floor((F.col("part") - 1) / F.col("total")).cast("int")
    # Whole passes hold every document; the last pass is cut, so only its order is needed token by token.
    dealt = (
        rows.join(F.broadcast(plan), "source").where("part > 0")  # one row per source
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("hash", _md5_number(F.lit(SEED), F.col("epoch").cast("string"), name))
        .withColumn("block", F.col("hash") % F.col("blocks"))
        .withColumn("name", name)
    )
    sizes = dealt.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("source", "epoch", "block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("block_start"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("hash", "name", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).cast("long"))
        .join(at, ["source", "epoch", "block"])
        .withColumn("start", F.col("epoch") * F.col("total") + F.col("block_start") + F.col("inner"))
    )
    return placed.where("start < part").select(
        F.col("key").alias(key), "source", "n_tokens", "epoch", "block", "start", "weight", "part"
    )
