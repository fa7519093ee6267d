"""Quality rules by distribution divergence, by DataFrame operations only.

Each language has two reference distributions over the whole corpus: its character classes and its common
words. A document is compared with its language's references by the Jensen-Shannon distance (base 2, 0 to 1);
one that is far from both kinds of text its language is made of is not kept. Short documents have no reliable
histogram and are not judged.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import materialize

#: Common words of a language's reference, and words a text must have for a verdict on classes and on words.
COMMON_WORDS, LEAST_WORDS_CLASSES, LEAST_WORDS_COMMON = 32, 50, 100
#: Largest distances that are kept: of classes, of common words, and of the share that common words have together in a
#: text that has fewer of them. Common words are about 27 % of a language's words, so a text without any is at 0.38.
#: Measured on texts of 100 words or more: prose in its own language up to 0.15, in another one mostly over 0.27
#: (closely related ones 0.1 to 0.2, which stay).
MOST_CLASSES, MOST_COMMON, MOST_MISSING = 0.32, 0.75, 0.25
#: Words that a language's sketch keeps track of, and the share of all words by which it can be wrong.
TRACKED = 8192
SKETCH_ERROR = 3.5 / TRACKED
#: The character classes of a histogram, and the characters of the class symbol.
CLASSES = ("upper", "digit", "space", "mark", "symbol", "not_ascii", "rest")
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """All words of a text; null: none. Splitting at one plain character needs no regular expression."""
    body = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        body = F.replace(body, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(body, " ", -1), "")


def symbol_count(body: Column) -> Column:
    """Characters of ``SYMBOLS`` in a text."""
    out = F.lit(0)
    for c in SYMBOLS:
        out = out + F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    return out.cast("long")


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of counts that sum to ``total`` from reference shares; null if either is null.

    Both arrays and the total should be columns, so that they are not worked out for every element anew.
    """

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def term(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    found = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.sqrt(F.greatest(found, F.lit(0.0))), 9)


def _one_of(listed: list[str]):
    return lambda w: w.isin(listed)


def common_candidates(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Per language the lower-cased words that may be among its common ones.

    A sketch over all texts gives four times as many. Where its error could hide a common word (the frequencies are
    flat there), all words of the language are counted.
    """
    each = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.explode(words(F.lower(text))).alias("word"))
    k = 4 * COMMON_WORDS
    found = each.groupBy("lang").agg(F.expr(f"approx_top_k(word, {k}, {TRACKED})").alias("top"), F.count("*").alias("n")).collect()
    out, flat = {}, []
    for r in found:  # k words per language
        top = sorted((x["count"] for x in r["top"]), reverse=True)
        if len(top) == k and top[COMMON_WORDS - 1] - SKETCH_ERROR * r["n"] <= max(top[-1], SKETCH_ERROR * r["n"]):
            flat.append(r["lang"])
        out[r["lang"]] = sorted(x["item"] for x in r["top"])
    if flat:
        counts = each.where(F.col("lang").isin(flat)).groupBy("lang", "word").count()
        rank = Window.partitionBy("lang").orderBy(F.desc("count"), "word")  # cut before the shuffle
        exact = counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= COMMON_WORDS).collect()
        out.update({name: sorted(r["word"] for r in exact if r["lang"] == name) for name in flat})
    return out


def base_counts(docs: DataFrame, candidates: dict[str, list[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the contract's counts, ``classes`` (by ``CLASSES``) and ``common``: counts of its language's candidate words."""
    split = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    split = split.withColumn("words", words(F.col("body"))).withColumn("lines", F.filter(F.split("body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    split = split.withColumn("hashes", F.coalesce(hashes, F.array().cast("array<bigint>")))
    # Without two equal hashes no window occurs twice; most texts end here.
    windows = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    ordered = split.withColumn("windows", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,at:int>>")))).drop("hashes")

    def equal(x: Column, other: Column) -> Column:
        same = x["h"] == other["h"]
        for k in range(3):
            same = same & (F.get("words", x["at"] + k) == F.get("words", other["at"] + k))
        return F.coalesce(same, F.lit(False))

    # Equal windows stand side by side (by hash, then compared); each place of one that occurs twice or more covers three words.
    twice = F.filter("windows", lambda x, i: equal(x, F.get("windows", i - 1)) | equal(x, F.get("windows", i + 1)))
    places = ordered.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("windows")
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + F.least(p + 3 - s["end"], F.lit(3))).alias("n")), lambda s: s["n"],
    )
    wanted = F.array().cast("array<string>")
    for name, listed in candidates.items():
        own = F.filter("lowered", _one_of(listed))
        wanted = F.when(F.col("lang") == name, own).otherwise(wanted)
    places = places.withColumn("lowered", words(F.lower("body"))).withColumn("wanted", F.sort_array(wanted))
    # Equal words stand side by side: where a run of them begins, and where the next one does, gives their number.
    starts = F.filter(F.transform("wanted", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: ~F.equal_null(F.get("wanted", x["at"] - 1), x["word"]))
    places = places.withColumn("starts", starts)
    tally = F.transform("starts", lambda x, i: F.struct(
        x["word"].alias("word"), (F.coalesce(F.get("starts", i + 1)["at"], F.size("wanted")) - x["at"]).cast("long").alias("n")))
    counted = places.select(
        "key", "lang", "body", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbol_count(F.col("body")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.map_from_entries(tally).alias("common"),
    )
    length = F.length("body").cast("long")
    by_regex = [F.regexp_count("body", F.lit(p)).cast("long") for p in (r"[A-Z]", r"[0-9]", r"[!-/:-@\[-`{-~]", r"[^\x00-\x7F]")]
    upper, digit, mark, other = by_regex
    space = length - F.col("word_chars")
    classes = F.array(upper, digit, space, mark - F.col("n_symbols"), F.col("n_symbols"), other, F.col("word_chars") - upper - digit - mark - other)
    return counted.withColumn("classes", classes).drop("body")


def references(counted: DataFrame) -> DataFrame:
    """Per language: ``ref_classes`` (shares), ``listed`` (its common words) and ``ref_common`` (their shares, then all others').

    Counts are over all documents. Words rank by count, then text.
    """
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    classes = counted.groupBy("lang").agg(F.sum("n_words").alias("all_words"), *sums)
    each = counted.select("lang", F.explode("common").alias("word", "n")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # candidates only
    top = each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= COMMON_WORDS)
    found = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"), F.sum("n").alias("listed_words"))
    counts = F.coalesce(F.col("top.n"), F.array().cast("array<bigint>"))
    total, chars = F.nullif(F.col("all_words"), F.lit(0)), F.lit(0)
    for i in range(len(CLASSES)):
        chars = chars + F.col(f"c{i}")
    chars = F.nullif(chars, F.lit(0))
    rest = (F.col("all_words") - F.coalesce("listed_words", F.lit(0))) / total
    return classes.join(found, "lang", "left").select(
        "lang", F.array(*(F.col(f"c{i}") / chars for i in range(len(CLASSES)))).alias("ref_classes"),
        F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("listed"),
        F.concat(F.transform(counts, lambda n: n / total), F.array(rest)).alias("ref_common"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: key, counts, ``base_failed``, ``js_classes``, ``js_common``, ``js_missing`` and ``kept``.

    ``js_missing`` is the distance between the text's and the language's shares of common and other words, 0 if the text has no fewer.

    ``base_failed``: under 50 words, or over half of the words lie in repeated three-word windows. ``kept`` is false for
    those and for texts that are long enough to judge and farther from a reference than allowed. Null texts
    have no words; a null language is a language of its own; distances are null where a text has no words.
    Repeated keys are judged row by row; an empty table gives an empty result; very long texts are judged whole by one
    task each; other columns are not read.
    """
    candidates = common_candidates(docs, text, lang)
    counted = materialize(base_counts(docs, candidates, key, text, lang), "counts")
    judged = counted.join(F.broadcast(references(counted)), "lang")  # one row per language
    own = F.transform("listed", lambda w: F.coalesce(F.try_element_at("common", w), F.lit(0).cast("long")))
    judged = judged.withColumn("own", own).withColumn("rest", F.col("n_words") - F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x))
    chars = F.lit(0)
    for i in range(len(CLASSES)):
        chars = chars + F.col("classes")[i]
    judged = judged.withColumn("own", F.concat("own", F.array("rest"))).withColumn("chars", F.nullif(chars, F.lit(0)))
    judged = judged.withColumn("total", F.nullif(F.col("n_words"), F.lit(0)))
    judged = judged.withColumn("js_classes", F.when(F.col("n_words") > 0, distance(F.col("classes"), F.col("chars"), F.col("ref_classes"))))
    judged = judged.withColumn("js_common", distance(F.col("own"), F.col("total"), F.col("ref_common")))
    pair = [F.col("n_words") - F.col("rest"), F.col("rest")]
    judged = judged.withColumn("pair", F.array(*pair)).withColumn("other", F.element_at("ref_common", -1)).withColumn("ref_pair", F.array(1 - F.col("other"), "other"))
    fewer = F.col("rest") / F.col("total") > F.col("other")
    missing = F.when(F.col("n_words") > 0, F.when(fewer, distance(F.col("pair"), F.col("total"), F.col("ref_pair"))).otherwise(F.lit(0.0)))
    judged = judged.withColumn("js_missing", missing)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.col("n_words") >= LEAST_WORDS_CLASSES) & (F.col("js_classes") > MOST_CLASSES)) | (
        (F.col("n_words") >= LEAST_WORDS_COMMON) & ((F.col("js_common") > MOST_COMMON) | (F.col("js_missing") > MOST_MISSING)))
    return judged.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "js_classes", "js_common", "js_missing",
    )
