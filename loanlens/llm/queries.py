"""The training-data operators as queries over the given tables."""

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import (
    chat_links,
    divergence,
    embedding_dedup,
    integrity_sql,
    langid,
    merkle,
    mixing,
    packing,
    prefix_hash,
    repair,
    secret_scan,
    simhash,
    token_store,
    tokens,
    toxicity,
)
from loanlens.llm.common import WORD, crc_mod, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def _secret_sql() -> str:
    """The spans by DuckDB: matches of each rule and the text between them give the positions."""
    parts = []
    for place, rule in enumerate(secret_scan.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT rid, {place} AS place, '{rule.kind}' AS kind, unnest(regexp_extract_all(body, '{p}')) AS whole,
                   unnest(regexp_extract_all(body, '{p}', {rule.group})) AS counted, unnest(list_slice(string_split_regex(body, '{p}'), 1, -2)) AS gap,
                   {rule.least} AS least, generate_subscripts(regexp_extract_all(body, '{p}'), 1) AS n
            FROM rows WHERE regexp_matches(body, '{p}')""")
    return f"""
        WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
        found AS ({" UNION ALL ".join(parts)}),
        placed AS (SELECT rid, place, kind, counted, least, length(whole) AS size,
                   sum(length(gap) + length(whole)) OVER (PARTITION BY rid, place ORDER BY n)::BIGINT AS stop FROM found),
        spans AS (SELECT rid, place, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM placed WHERE length(counted) >= least),
        lists AS (SELECT rid, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
                  string_agg(span, ',' ORDER BY start, place) AS spans, string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base FROM spans GROUP BY rid)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM rows LEFT JOIN lists USING (rid)"""


@query(_secret_sql())
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(place: int):
        return F.size(F.filter("secrets", lambda s: s["place"] == place)).cast("long")

    base = F.filter("secrets", lambda s: s["place"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"),
    )


#: Shares, the bisected exponent and the dealt rows, by the same rules in SQL.
_MIX_SQL = f"""
    WITH RECURSIVE sizes AS (
        SELECT doc_id, coalesce(source, '') AS source, greatest(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')), 1)::BIGINT AS n_tokens FROM documents),
    totals AS (SELECT source, sum(n_tokens)::BIGINT AS total, count(*) AS docs FROM sizes GROUP BY source),
    whole AS (SELECT sum(total)::BIGINT AS budget, count(*) AS n FROM totals),
    shares AS (SELECT source, total, total / budget AS share, budget, n FROM totals, whole),
    entropies AS (
        SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
        UNION ALL
        SELECT step + 1,
               CASE WHEN enough THEN (low + high) / 2 ELSE low END, CASE WHEN enough THEN high ELSE (low + high) / 2 END
        FROM (SELECT step, low, high, (SELECT n < 2 OR -sum(p / z * ln(p / z)) / ln(n) >= {mixing.TARGET_ENTROPY}
              FROM (SELECT pow(share, (low + high) / 2) AS p, n, sum(pow(share, (low + high) / 2)) OVER () AS z FROM shares) GROUP BY n) AS enough
              FROM entropies WHERE step < {mixing.BISECTIONS})),
    repeats AS (
        SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
        UNION ALL
        SELECT step + 1, CASE WHEN few THEN low ELSE (low + high) / 2 END, CASE WHEN few THEN (low + high) / 2 ELSE high END
        FROM (SELECT step, low, high, (SELECT max(budget * p / z / total) <= {mixing.MAX_REPEATS}
              FROM (SELECT budget, total, pow(share, (low + high) / 2) AS p, sum(pow(share, (low + high) / 2)) OVER () AS z FROM shares)) AS few
              FROM repeats WHERE step < {mixing.BISECTIONS})),
    exponent AS (SELECT greatest(
        CASE WHEN (SELECT bool_or(n < 2) OR -sum(share * ln(share)) / ln(max(n)) >= {mixing.TARGET_ENTROPY} FROM shares) THEN 1.0
             ELSE (SELECT high FROM entropies WHERE step = {mixing.BISECTIONS}) END,
        CASE WHEN (SELECT max(budget / n / total) <= {mixing.MAX_REPEATS} FROM shares) THEN 0.0
             ELSE (SELECT high FROM repeats WHERE step = {mixing.BISECTIONS}) END) AS x),
    parts AS (SELECT source, weight, total, floor(budget * weight)::BIGINT AS part, greatest(1, ceil(docs / {mixing.BLOCK_DOCS}))::BIGINT AS blocks
              FROM (SELECT s.source, s.total, s.budget, t.docs, round(pow(share, x) / sum(pow(share, x)) OVER (), 9) AS weight
                    FROM shares s JOIN totals t USING (source), exponent)),
    passes AS (SELECT s.*, p.* EXCLUDE (source), unnest(range(((part - 1) // total) + 1))::INT AS epoch FROM sizes s JOIN parts p USING (source) WHERE part > 0),
    hashed AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::BIGINT AS hash FROM passes),
    placed AS (SELECT *, epoch * total + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch
                      ORDER BY hash % blocks, hash, coalesce(doc_id::VARCHAR, ''), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM hashed)
    SELECT doc_id, source, n_tokens, epoch, hash % blocks AS block, start::BIGINT AS start, weight FROM placed WHERE start < part"""


@query(_MIX_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("part")


@query()
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write(read_table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"), end_id=2)
    found = token_store.read(spark, files)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Every user turn calls the tool ``reply``; the assistant turn after it is the result; a call needs the one two turns before.
_REPLY = {"reply": {"prompt": ("string", True), "turn": ("number", True)}}


@query("""
    WITH RECURSIVE calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
    levels AS (
        SELECT DISTINCT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
        UNION ALL SELECT DISTINCT c.conv_id, c.turn, level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
    both_sides AS (
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.conv_id IS NOT NULL AS is_call,
               r.conv_id IS NOT NULL AS is_result, c.text, r.content, r.n
        FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn)
    SELECT b.conv_id || ':' || b.turn AS call_id, CASE WHEN is_call THEN 'reply' END AS tool, l.level::INT AS level,
           CASE WHEN is_call AND is_result THEN 'linked' WHEN is_call THEN 'no result' ELSE 'no call' END AS status,
           coalesce(n, 0)::BIGINT AS n_results, CASE WHEN is_call AND text IS NULL THEN 'missing prompt' ELSE '' END AS problems,
           '{"arguments":' || CASE WHEN NOT is_call THEN 'null' WHEN text IS NULL THEN '{"turn":' || b.turn || '}'
               ELSE '{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || b.turn || '}' END
           || ',"id":"' || b.conv_id || ':' || b.turn || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
           || ',"tool":' || CASE WHEN is_call THEN '"reply"' ELSE 'null' END || '}' AS json
    FROM both_sides b LEFT JOIN levels l ON is_call AND l.conv_id = b.conv_id AND l.turn = b.turn""")
def op4_chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")

    def name(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    calls = turns.where("role = 'user'").select(
        name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat_links.link(calls, results, _REPLY).withColumn("problems", F.array_join("problems", ","))


def _divergence_sql() -> str:
    d = divergence
    w = WORD
    jsd = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
    classes = ("[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]", "m", "[#*$%&|<>]", "[^\\x00-\\x7F]", "r")
    count = {c: f"len(regexp_extract_all(body, '{c}'))" for c in classes if len(c) > 1}
    mark = "len(regexp_extract_all(body, '[!-/:-@\\[-`{-~]'))"
    return f"""
    WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body FROM documents),
    split AS (SELECT *, regexp_extract_all(body, '{w}') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{w}')) AS lines FROM rows),
    each AS (SELECT rid, lang, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
    windows AS (SELECT rid, pos, word || ' ' || lead(word) OVER (PARTITION BY rid ORDER BY pos) || ' ' || lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS w FROM each),
    twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w) AS n FROM windows WHERE w IS NOT NULL) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    base AS (SELECT rid, doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             {count["[#*$%&|<>]"]}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, [{count["[A-Z]"]}, {count["[0-9]"]}, length(body) - coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT,
             {mark} - {count["[#*$%&|<>]"]}, {count["[#*$%&|<>]"]}, {count[classes[5]]},
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT - {count["[A-Z]"]} - {count["[0-9]"]} - {mark} - {count[classes[5]]}] AS classes
             FROM split LEFT JOIN covered USING (rid)),
    cells AS (SELECT rid, lang, unnest(classes) AS n, unnest(range({len(d.CLASSES)})) AS cell FROM base WHERE n_words > 0),
    every_cell AS (SELECT lang, unnest(classes) AS n, unnest(range({len(d.CLASSES)})) AS cell FROM base),
    ref_cells AS (SELECT lang, cell, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM every_cell GROUP BY lang, cell),
    js_c AS (SELECT rid, round(sqrt(greatest(sum({jsd}) / 2, 0)), 9) AS js FROM
             (SELECT c.rid, c.n / sum(c.n) OVER (PARTITION BY c.rid) AS p, q FROM cells c JOIN ref_cells USING (lang, cell)) GROUP BY rid),
    tops AS (SELECT lang, word, n FROM (SELECT lang, lower(word) AS word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, lower(word)) AS r
             FROM each GROUP BY lang, lower(word)) WHERE r <= {d.COMMON_WORDS}),
    totals AS (SELECT lang, sum(n_words) AS n FROM base GROUP BY lang),
    ref_words AS (SELECT t.lang, t.word, t.n / s.n AS q FROM tops t JOIN totals s USING (lang)
                  UNION ALL SELECT s.lang, NULL, 1 - coalesce(sum(t.n), 0) / any_value(s.n) FROM totals s LEFT JOIN tops t USING (lang) GROUP BY s.lang),
    own AS (SELECT rid, lower(word) AS word, count(*) AS n FROM each GROUP BY rid, lower(word)),
    shares AS (SELECT b.rid, r.word, r.q, coalesce(o.n, 0) / b.n_words AS p FROM base b JOIN ref_words r USING (lang)
               LEFT JOIN own o ON o.rid = b.rid AND o.word = r.word WHERE b.n_words > 0),
    filled AS (SELECT rid, word, q, CASE WHEN word IS NULL THEN 1 - sum(p) OVER (PARTITION BY rid) ELSE p END AS p FROM shares),
    js_w AS (SELECT rid, round(sqrt(greatest(sum({jsd}) / 2, 0)), 9) AS js FROM filled GROUP BY rid),
    pairs AS (SELECT rid, p > q AS fewer, unnest([p, 1 - p]) AS p, unnest([q, 1 - q]) AS q FROM filled WHERE word IS NULL),
    js_m AS (SELECT rid, CASE WHEN bool_and(fewer) THEN round(sqrt(greatest(sum({jsd}) / 2, 0)), 9) ELSE 0 END AS js FROM pairs GROUP BY rid),
    judged AS (SELECT b.*, c.js AS js_classes, w.js AS js_common, m.js AS js_missing, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
               FROM base b LEFT JOIN js_c c USING (rid) LEFT JOIN js_w w USING (rid) LEFT JOIN js_m m USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce((n_words >= {d.LEAST_WORDS_CLASSES} AND js_classes > {d.MOST_CLASSES})
               OR (n_words >= {d.LEAST_WORDS_COMMON} AND (js_common > {d.MOST_COMMON} OR js_missing > {d.MOST_MISSING})), false) AS kept,
           round(js_classes, 5) AS js_classes, round(js_common, 5) AS js_common, round(js_missing, 5) AS js_missing
    FROM judged"""


@query(_divergence_sql())
def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.judge(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 5) for c in ("js_classes", "js_common", "js_missing")})


@query(integrity_sql.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")

    def leaf(text):
        return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    rows = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(crc_mod(F.col("doc_id"), 3) == 0, leaf(lowered)).alias("tampered"))
    found = merkle.fold(merkle.build(rows), "tampered")
    return found.select(
        "row.doc_id", F.lower(F.hex("row.leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


@query()
def op12_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(integrity_sql.REPAIR)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(repair.damage(turns))
    every = turns.select("conv_id").distinct().withColumn("conv", repair.key_name(F.col("conv_id")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, "conv", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
