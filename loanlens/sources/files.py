"""Readers and writers for application files, request logs and result exports."""

import csv
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.functions.names import normalize_name, quote

CORRUPT = "_corrupt_record"


def _first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a file on any file system that Spark reads, compressed ones included; None if it is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def csv_layouts(spark: SparkSession, path: str | list[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by their header line. Only first lines are read, many files at a time; files without a line have no layout.

    A header is one line; a byte-order mark and quotes are taken off. A name that comes twice in a header is refused.
    """
    # the content is not read, only the listing
    paths = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(paths, pool.map(lambda p: _first_line(spark, p), paths)):
            if line is None:
                continue
            header = tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), ()))
            if len(set(header)) < len(header):
                raise ValueError(f"a column comes twice in the header of {file}: {header}")
            found.setdefault(header, []).append(file)
    return found


def _wider(one: T.DataType, two: T.DataType) -> T.DataType:
    """A type that takes the values of both."""
    numbers = (T.NumericType,)
    if one == two:
        return one
    return T.DoubleType() if isinstance(one, numbers) and isinstance(two, numbers) else T.StringType()


def read_applications_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
                          required: list[str] = (), names: Callable[[list[str]], list[str]] | None = None, infer: bool = True) -> DataFrame:
    """Header CSV with a given or inferred schema (without ``infer``: text); a required column that a file lacks fails before any scan.

    Files may have different headers: those of one layout are read together, in splits, each column under its file's own
    name, and the layouts are united by name (absent columns are null). ``names`` maps a header to column names, so
    that layouts with foreign headers meet; two columns of a file under one name are coalesced in their order.
    A type is inferred from all files: numbers widen to double, other conflicts to text. With a ``schema``, lines that do not
    fit it are kept in ``_corrupt_record``. The plan has one scan per layout.
    """
    layouts = csv_layouts(spark, path)
    if not layouts:
        raise ValueError(f"no CSV file with a header at {path}")
    called = {h: names(list(h)) if names else list(h) for h in layouts}
    for header, own in called.items():
        absent = [c for c in required if c not in own]
        if absent:
            raise ValueError(f"missing columns {absent} in {layouts[header][0]}; found {list(header)}")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    kinds = {f.name: f.dataType for f in schema} if schema is not None else {}
    if schema is None and infer:
        for header, files in layouts.items():
            inferred = spark.read.option("header", True).option("inferSchema", True).csv(files).schema
            for name, field in zip(called[header], inferred):
                kinds[name] = _wider(kinds.get(name, field.dataType), field.dataType)
    parts = []
    for header, files in layouts.items():
        typed = T.StructType([T.StructField(h, kinds.get(c, T.StringType())) for h, c in zip(header, called[header])])
        own: dict[str, list[str]] = {}
        for h, c in zip(header, called[header]):
            own.setdefault(c, []).append(quote(h))
        picked = [F.coalesce(*map(F.col, hs)).alias(c) if len(hs) > 1 else F.col(hs[0]).alias(c) for c, hs in own.items()]
        if schema is not None:
            typed = typed.add(CORRUPT, T.StringType())
            picked.append(F.col(CORRUPT))
            rows = reader.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(files)
        else:
            rows = reader.schema(typed).csv(files)
        parts.append(rows.select(*picked))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def canonical_names(header: list[str]) -> list[str]:
    """Names of the application table for a header: normalised, aliases replaced."""
    aliases = {normalize_name(k): v for k, v in S.ALIASES.items()}
    return [aliases.get(normalize_name(h), normalize_name(h)) for h in header]


def read_text_csv(spark: SparkSession, path: str | list[str], names: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Header CSV with every cell as text, for cell coercion afterwards; files may have headers of their own, as above."""
    return read_applications_csv(spark, path, names=names, infer=False)


def read_applications_json(spark: SparkSession, path: str, schema: T.StructType = S.APPLICATION_SCHEMA,
                           multi_line: bool = True) -> DataFrame:
    """JSON arrays of (partial) applications; use one object per line for files that must be split."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines request log: one row for each line that is a JSON object.

    Whether a line counts does not depend on the columns read. A value that does not fit its column's type is
    null; its row stays.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in S.REQUEST_LOG_SCHEMA])
    lines = spark.read.text(path).where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT<"))
    parsed = lines.select(F.from_json("value", texts).alias("line"))
    return parsed.select(*(F.col("line")[f.name].try_cast(f.dataType).alias(f.name) for f in S.REQUEST_LOG_SCHEMA))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(path)


def export_csv(df: DataFrame, path: str) -> str:
    """Write a table as a folder of CSV parts with headers."""
    df.write.option("header", True).csv(path)
    return path


def export_training_csv(features: DataFrame, label: str, path: str) -> str:
    return export_csv(features.withColumnRenamed(label, "loan_status"), path)


def batch_result_rows(results: DataFrame) -> DataFrame:
    """The batch export: position from 1, tier, percent, label and status; missing values as N/A."""
    def shown(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    return results.select(
        (F.col("row_index") + 1).alias("Row"), shown("risk_level").alias("Risk Level"),
        shown("probability_default_percent").alias("Probability %"),
        shown("binary_prediction").alias("Prediction"), shown("status").alias("Status"),
    )
