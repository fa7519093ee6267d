"""Column mapping, header matching and schema evolution."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.functions import names as N


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[N.normalize_name(c) for c in df.columns])


def rename_aliases(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by ``mapping`` (default: the known aliases); its keys are normalised like the headers.

    Several sources of one target are coalesced in column order.
    """
    table = {N.normalize_name(k): v for k, v in (mapping or S.ALIASES).items()}
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        sources.setdefault(table.get(column, column), []).append(column)
    return df.select(*[
        (F.col(f"`{cs[0]}`") if len(cs) == 1 else F.coalesce(*[F.col(f"`{c}`") for c in cs])).alias(target)
        for target, cs in sources.items()
    ])


def _overlaps(a: Column, b: Column) -> Column:
    """Either text contains the other; an empty one matches nothing."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def _first(candidates: Column) -> Column:
    return F.try_element_at(candidates, F.lit(1))


def header_candidates(header: Column, columns: list[str], filler: str = N.PLAIN_FILLER) -> Column:
    """The table columns whose compact name equals, contains or lies in the header's, in order."""
    compacted = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(N.compact_name(c, filler)).alias("key")) for c in columns
    ])
    hits = F.filter(compacted, lambda c: _overlaps(N.compact(header, filler), c["key"]))
    return F.transform(hits, lambda c: c["column"])


def automap_headers(headers: DataFrame, columns: list[str] = S.CANONICAL) -> DataFrame:
    """Add ``mapped_column``: the first table column that matches ``header``, else null.

    The column list is part of the plan, so no join is needed, however many headers there are.
    """
    return headers.withColumn("mapped_column", _first(header_candidates(F.col("header"), columns)))


def join_headers_fuzzy(headers: DataFrame, columns: list[str] = S.CANONICAL) -> DataFrame:
    """One row per header and matching table column, with the column's position."""
    hits = header_candidates(F.col("header"), columns)
    return headers.select("*", F.posexplode(hits).alias("match_position", "mapped_column"))


def automap_headers_tiered(headers: DataFrame, columns: list[str] = S.CANONICAL) -> DataFrame:
    """Add ``mapped_column`` and ``match_tier`` (1 exact table column .. 5 fuzzy; null = unmatched)."""
    columns = [c for c in columns if c not in S.METADATA_COLUMNS]
    header, key = F.col("header"), N.compact(F.col("header"))
    aliases = F.array(*[
        F.struct(F.lit(N.compact_name(p)).alias("pattern"), F.lit(c).alias("column"))
        for p, c in S.FORM_ALIASES
    ])
    hits = F.filter(aliases, lambda a: _overlaps(key, a["pattern"]))
    tiers = [
        F.when(header.isin(columns), header),
        F.when(header.isin(S.CANONICAL), header),
        F.when(key.isin(S.CANONICAL), key),
        F.try_element_at(hits, F.lit(1))["column"],
        _first(header_candidates(header, columns, N.TIERED_FILLER)),
    ]
    tier = F.coalesce(*[F.when(t.isNotNull(), F.lit(i)) for i, t in enumerate(tiers, 1)])
    return headers.withColumns({"mapped_column": F.coalesce(*tiers), "match_tier": tier})


def schema_diff(headers: DataFrame, known: list[str]) -> DataFrame:
    """Classify ``(file, column_name)`` rows: forbidden (a target), existing, or new."""
    column = F.col("column_name")
    return headers.withColumn(
        "status",
        F.when(column.isin(S.TARGETS), "forbidden").when(column.isin(known), "existing").otherwise("new"),
    )


def storage_type(dtype: T.DataType) -> str:
    return "double" if isinstance(dtype, T.NumericType) else "string"


def evolve_schema(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """``table`` widened by the columns only ``incoming`` has, with the incoming rows appended.

    New columns become double or string; adding a column twice changes nothing. A column in which an incoming
    value does not fit the stored type becomes text in the result, so that no value is lost (one counting pass).
    """
    shared = [c for c in incoming.columns if c in table.columns]
    misfits = [c for c, n in count_misfits(incoming, table.schema, shared).items() if n]
    table = table.withColumns({c: F.col(f"`{c}`").cast("string") for c in misfits})
    fresh = [f for f in incoming.schema if f.name not in table.columns]
    for f in fresh:
        N.check_name(f.name)
    typed = incoming.withColumns({
        **{f.name: F.col(f.name).cast(storage_type(f.dataType)) for f in fresh},
        **{c: F.col(c).try_cast(table.schema[c].dataType) for c in incoming.columns if c in table.columns},
    })
    return table.unionByName(typed, allowMissingColumns=True)


def count_misfits(incoming: DataFrame, stored: T.StructType, columns: list[str]) -> dict[str, int]:
    """Non-null values per column that cannot be cast to the stored type."""
    kinds = {f.name: f.dataType for f in stored}
    differ = [c for c in columns if incoming.schema[c].dataType != kinds[c]]
    if not differ:
        return {}
    lost = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kinds[c]).isNull()).alias(c) for c in differ]
    return incoming.agg(*lost).first().asDict()


def add_column(df: DataFrame, name: str, dtype: str = "double") -> DataFrame:
    return df if N.check_name(name) in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def application_table_schema(incoming: T.StructType) -> T.StructType:
    """Five metadata columns, then the incoming columns not among them."""
    head = T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("application_status", T.StringType()),
        T.StructField("notes", T.StringType()),
    ])
    kinds = {"double": T.DoubleType(), "string": T.StringType()}
    seen = set(head.names)
    for f in incoming:
        if f.name not in seen:
            head = head.add(f.name, kinds[storage_type(f.dataType)])
            seen.add(f.name)
    return head


def create_dynamic_table(incoming: DataFrame) -> DataFrame:
    """``incoming`` in the layout of a new application table; absent metadata is null, status pending."""
    target = application_table_schema(incoming.schema)

    def made(f: T.StructField) -> Column:
        if f.name in incoming.columns:
            return F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
        default = "pending" if f.name == "application_status" else None
        return F.lit(default).cast(f.dataType).alias(f.name)

    return incoming.select(*[made(f) for f in target])


def infer_column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, inferred_type)``: double if every non-null text parses, else string; one pass."""
    columns = columns or df.columns
    row = df.agg(*[
        (F.count(F.col(f"`{c}`")) == F.count(F.col(f"`{c}`").try_cast("double"))).alias(c) for c in columns
    ])
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.when(F.col(f"`{c}`"), "double").otherwise("string").alias("inferred_type"),
        )
        for c in columns
    ])
    return row.select(F.inline(entries))


def drop_targets(df: DataFrame) -> DataFrame:
    left = df.drop(*S.TARGETS)
    if not left.columns:
        raise ValueError("no feature columns left after dropping the target columns")
    return left


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def pack_features(df: DataFrame, columns: list[str], name: str = "input_features",
                  keep_nulls: bool = False) -> DataFrame:
    """Fold ``columns`` (targets excepted) into one JSON text; null entries are left out by default."""
    picked = [c for c in columns if c not in S.TARGETS]
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return df.withColumn(name, F.to_json(F.struct(*picked), options))


def unpack_features(df: DataFrame, schema: T.StructType, name: str = "input_features") -> DataFrame:
    """Spread a JSON text over the columns of ``schema``; absent keys are null."""
    return df.withColumn("_f", F.from_json(name, schema)).select(
        *[c for c in df.columns if c != name and c not in schema.names], "_f.*"
    )


def feature_keys(df: DataFrame, name: str = "input_features") -> DataFrame:
    """The distinct keys that occur in a JSON text column."""
    return df.select(F.explode(F.json_object_keys(name)).alias("feature")).distinct()


def feature_kinds(df: DataFrame, name: str = "input_features") -> DataFrame:
    """``(feature, kind)`` of every key of a JSON text column, in one pass: double if all its values are numbers, else string.

    A number in quotes is a number; nested values are text; a key that holds nothing but nulls is a double. Texts that are no object have no keys.
    """
    entries = F.explode(F.from_json(name, "map<string, string>"))
    number = F.count(F.col("value").try_cast("double")) == F.count("value")
    return df.select(entries).groupBy(F.col("key").alias("feature")).agg(F.when(number, "double").otherwise("string").alias("kind"))


def rename_original_dataset(df: DataFrame) -> DataFrame:
    """Raw dataset to canonical names; categoricals upper-cased, other features to double where they parse."""
    df = df.withColumnsRenamed(S.RAW_NAMES)
    made = {c: F.upper(F.col(c).cast("string")) for c in S.CATEGORICAL if c in df.columns}
    made |= {c: F.col(c).try_cast("double") for c in S.NUMERIC if c in df.columns}
    return df.withColumns(made)
