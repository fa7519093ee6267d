"""Tool-call linking for chat data, by DataFrame operations only.

Calls and results meet by identifier in a hash join. Calls are ordered topologically: a call's level is one
more than the highest level among the calls it depends on; chains are halved each round. Arguments are checked against the tool's schema, and
each linked call becomes canonical JSON: keys sorted, no white space, numbers in their shortest form.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.session import materialize, scratch_path

#: A tool's schema: argument name -> (JSON type, required). Types: string, number, boolean, object, array.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}


def _quoted(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"argument name {name!r}")
    return f"$['{name}']"


def problems(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """What speaks against a call's arguments (JSON text), sorted; empty: valid.

    ``unknown tool``, ``not json``, ``not an object``, ``missing <name>``, ``type <name>``; arguments that the schema does not name
    are allowed. A JSON null counts as missing.
    """
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    out = F.array(F.lit("unknown tool"))
    for name, fields in schemas.items():
        checks = []
        for field, (want, required) in fields.items():
            own = F.schema_of_variant(F.try_variant_get(parsed, _quoted(field), "variant"))
            absent = own.isNull() | (own == "VOID")
            if required:
                checks.append(F.when(absent, F.lit(f"missing {field}")))
            checks.append(F.when(~absent & ~own.rlike(_TYPES[want]), F.lit(f"type {field}")))
        found = F.array_sort(F.array_compact(F.array(*checks))) if checks else F.array().cast("array<string>")
        fits = F.when(parsed.isNull(), F.array(F.lit("not json"))).when(~kind.rlike("^OBJECT<"), F.array(F.lit("not an object"))).otherwise(found)
        out = F.when(tool == name, fits).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """``call_id`` and ``level`` of calls ``(call_id, depends_on array<string>)``; null level: on or behind a cycle.

    Each round settles the calls without open dependencies (Kahn's rule) and shortens all chains by half: a dependency on
    a call that itself waits for one call only is replaced by that one, with the sum of their distances. So rounds grow
    with the logarithm of a chain's length, and one by one only where calls with several open dependencies follow each
    other. A distance of as many steps as there are calls is a cycle. A dependency on a call that is not there counts as
    settled. Each round is written, and its plan reads written tables only.
    """
    spark = calls.sparkSession
    named = calls.where("call_id is not null")
    waiting = materialize(named.select("call_id", F.lit(0).cast("long").alias("base")).distinct(), "calls")
    edges = named.select("call_id", F.explode("depends_on").alias("needs")).where("needs is not null").distinct()
    edges = edges.join(waiting.select(F.col("call_id").alias("needs")), "needs", "left_semi").select("call_id", "needs", F.lit(1).cast("long").alias("steps"))
    total, folder = waiting.count(), scratch_path(spark, "levels")

    def settle(rows: DataFrame, level: Column) -> None:
        rows.select("call_id", level.cast("int").alias("level")).write.mode("append").parquet(folder)

    free, least = waiting.limit(0), waiting.limit(0)
    while True:
        # dependencies settled in the round before become a lower bound
        bound = free.select(F.col("call_id").alias("needs"), F.col("base").alias("settled"))
        met = edges.join(bound, "needs", "left").select(
            "call_id", F.when(F.col("settled").isNull(), F.col("needs")).alias("needs"), "steps", (F.col("steps") + F.col("settled")).alias("base")
        )
        met = materialize(met, "met")
        least = least.unionByName(met.where("base is not null").select("call_id", "base")).groupBy("call_id").agg(F.max("base").alias("least"))
        edges = met.where("needs is not null").select("call_id", "needs", "steps")
        ends = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.max("needs").alias("next"), F.max("steps").alias("on"))
        state = waiting.join(least, "call_id", "left").join(ends, "call_id", "left").fillna(0, ["n"])
        state = materialize(state.withColumn("base", F.greatest("base", "least")).drop("least"), "waiting")
        free, left = state.where("n = 0").select("call_id", "base"), state.where("n > 0").select("call_id", "base")
        settle(free, F.col("base"))
        count = state.agg(F.count_if(F.col("n") == 0).alias("free"), F.count_if(F.col("n") > 0).alias("left")).first()
        if not count["left"]:
            break
        # a dependency on a call with one dependency of its own passes on to that one
        seen = state.select(F.col("call_id").alias("needs"), F.col("base").alias("reached"), "n", "next", "on")
        one = F.col("n") == 1
        steps = F.when(one, F.col("steps") + F.col("on")).otherwise(F.col("steps"))
        moved = edges.join(seen, "needs", "left").select(
            "call_id", F.when(one, F.col("next")).otherwise(F.col("needs")).alias("needs"), steps.alias("steps"),
            F.when(one, F.col("steps") + F.col("reached")).alias("base"), (F.col("n").isNull() | (steps >= total)).alias("lost"),
        )
        moved = materialize(moved, "moved")
        if not count["free"] and moved.where("base is not null or lost").isEmpty():
            settle(left, F.lit(None))  # only cycles of calls with several dependencies are left, and what waits for them
            break
        lost = materialize(moved.where("lost").select("call_id").distinct(), "lost")
        settle(lost, F.lit(None))
        waiting = left.join(lost, "call_id", "left_anti")
        least = moved.where("base is not null").select("call_id", "base")
        edges = moved.groupBy("call_id", "needs").agg(F.max("steps").alias("steps")).join(lost, "call_id", "left_anti")
    return spark.read.schema("call_id string, level int").parquet(folder)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per identifier of results that no call has.

    ``calls``: ``call_id``, ``tool``, ``arguments`` (JSON text), ``depends_on`` (identifiers); ``results``: ``call_id``,
    ``content``. Other columns are not read. Result: ``call_id``, ``tool``, ``level``, ``status`` (``linked``, ``no result``,
    ``no call``), ``n_results``, ``problems`` and ``json``. Of several results of an identifier the smallest is
    linked and all are counted; calls with equal identifiers keep their rows. Null identifiers link with
    nothing and keep their rows. Texts of any length pass whole. Empty tables give no rows.
    """
    wanted = calls.select("call_id", "tool", "arguments", "depends_on")
    ordered = wanted.join(levels(wanted), "call_id", "left").withColumn("is_call", F.lit(True))
    named = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    loose = results.where("call_id is null").select("call_id", "content", F.lit(1).cast("long").alias("n_results"))
    answers = named.unionByName(loose).withColumnRenamed("call_id", "result_id").withColumn("is_result", F.lit(True))
    both = ordered.join(answers, F.col("call_id") == F.col("result_id"), "full")
    status = F.when(F.col("is_call") & F.col("is_result"), "linked").when(F.col("is_call"), "no result").otherwise("no call")
    parsed = F.try_parse_json("arguments")
    arguments = F.when(parsed.isNull(), _json_text(F.col("arguments"))).otherwise(F.to_json(parsed))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), _json_text(F.coalesce("call_id", "result_id")),
        F.lit(',"result":'), _json_text(F.col("content")), F.lit(',"tool":'), _json_text(F.col("tool")), F.lit("}"),
    )
    bad = F.when(F.col("is_call"), problems(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    return both.select(F.coalesce("call_id", "result_id").alias("call_id"), "tool", "level", status.alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), bad.alias("problems"), body.alias("json"))


def _json_text(text: Column) -> Column:
    """A text as JSON, null as ``null``."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))
