"""Statistics of a growing history: each import adds a part, and old rows are not read again.

A part holds the moments of every numeric column, its distinct values with their counts in the order of the values, a
histogram of them by ``value_bucket``, and the counts of categorical values. Moments and counts of parts add up.
An exact quantile needs the sum of the histograms, which tells the bucket of its rank, and the values of
that bucket alone.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.names import quoted
from loanlens.operators.ordered import running_totals
from loanlens.operators.stats import SMALL_COUNT, FillValues, tall
from loanlens.streaming.journal import Journal

#: Buckets for each power of two, so that a bucket spans 0.27 % of its values.
STEPS = 256
#: Added to a binary logarithm so that it is positive for every double; and the bucket of infinity.
_LIFT, _LAST = 1100, 1 << 20


def value_bucket(value: Column) -> Column:
    """An integer that never falls as ``value`` rises; 0 for zero, and at most ``2 * _LAST + 1`` of them."""
    size = F.abs(value)
    step = F.floor((F.log2(size) + _LIFT) * STEPS).cast("int") + 1
    step = F.when(size == 0, 0).when(size == float("inf"), _LAST).otherwise(step)
    return F.when(value < 0, -step).otherwise(step)


class HistoryStatistics:
    """The parts under ``root``, one for each numbered import.

    A part counts once it is whole; one that a lost driver left unfinished is replaced when its import is added again,
    and a whole one is not added twice. Quantiles leave out nulls and NaN, moments only nulls, as in
    ``stats``. Values that are corrected after their import keep their old part.
    """

    def __init__(self, spark: SparkSession, root: str, numeric: list[str] = S.NUMERIC, text: list[str] = S.CATEGORICAL):
        self.spark, self.numeric, self.text = spark, list(numeric), list(text)
        self.journal = Journal(spark, root)

    def add(self, df: DataFrame, number: int) -> bool:
        """Add the rows of import ``number``; False if it is there already. A column that ``df`` lacks adds nothing."""
        if self.journal.begin(number) is None:
            return False
        kinds = {**dict.fromkeys(self.numeric, "double"), **dict.fromkeys(self.text, "string")}
        rows = df.select(*[(quoted(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        if self.numeric:
            self.journal.write("moments", number, _moments(rows, self.numeric))
            values = tall(rows, self.numeric).where(F.col("value").isNotNull() & ~F.isnan("value"))
            counted = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            place = ["feature", "bucket", "value"]
            ordered = counted.withColumn("bucket", value_bucket(F.col("value"))).repartitionByRange(*place).sortWithinPartitions(*place)
            self.journal.write("values", number, ordered)
            written = self.journal.read_batch("values", number)
            self.journal.write("histogram", number, written.groupBy("feature", "bucket").agg(F.sum("n").alias("n")))
        if self.text:
            words = tall(rows, self.text, dtype="string").where(F.col("value").isNotNull())
            self.journal.write("words", number, words.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
        self.journal.commit(number, 0, 0)
        return True

    def moments(self) -> DataFrame:
        """``(feature, min, max, mean, std)`` of all parts; the deviation is the sample's."""
        parts = self.journal.read("moments")
        whole = parts.groupBy("feature").agg(
            F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("rows"),
            F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("whole_mean"),
        )
        around = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("whole_mean"), F.lit(2)))
        keys = ["feature", "min", "max", "whole_mean", "rows"]
        # one row per column and part
        return parts.select("feature", "n", "mean", "squares").join(whole, "feature").groupBy(*keys).agg(around.alias("squares")).select(
            "feature", "min", "max", F.col("whole_mean").alias("mean"),
            F.when(F.col("rows") > 1, F.sqrt(F.col("squares") / (F.col("rows") - 1))).alias("std"),
        )

    def _places(self, probabilities: dict[str, float]) -> list:
        """Bucket of each wanted rank, and the rank within it: two rows for each column and quantile."""
        histogram = self.journal.read("histogram").groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("feature")  # a bounded number of buckets
        summed = histogram.withColumns({"upto": F.sum("n").over(own.orderBy("bucket")), "rows": F.sum("n").over(own)})
        wanted = F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), rank((F.col("rows") - 1) * F.lit(q)).cast("long").alias("rank"),
                     F.pmod((F.col("rows") - 1) * F.lit(q), F.lit(1.0)).alias("part"))
            for name, q in probabilities.items() for end, rank in (("lo", F.floor), ("hi", F.ceil))
        ])
        found = summed.select("feature", "bucket", "n", "upto", F.inline(wanted))
        found = found.where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        return found.select("feature", "name", "end", "part", "bucket", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()

    def bracket_values(self, places: list) -> DataFrame:
        """``(feature, bucket, value, n)`` of the buckets named by ``places``; the scan skips all others."""
        buckets: dict[str, set[int]] = {}
        for p in places:
            buckets.setdefault(p["feature"], set()).add(p["bucket"])
        here = F.lit(False)
        for feature, own in buckets.items():
            here = here | ((F.col("feature") == feature) & F.col("bucket").isin(*sorted(own)))
        return self.journal.read("values").where(here).groupBy("feature", "bucket", "value").agg(F.sum("n").alias("n"))

    def quantiles(self, probabilities: dict[str, float]) -> DataFrame:
        """``(feature, <name>...)``: exact, linearly interpolated; columns without a value are left out."""
        places = self._places(probabilities)
        names = ", ".join(f"`{n}` double" for n in probabilities)
        if not places:
            return self.spark.createDataFrame([], f"feature string, {names}")
        values = self.bracket_values(places)
        if sum({(p["feature"], p["bucket"]): p["n"] for p in places}.values()) <= SMALL_COUNT:
            upto = F.sum("n").over(Window.partitionBy("feature", "bucket").orderBy("value"))
            ranked = values.withColumn("upto", upto)
        else:
            ranked = running_totals(values, ["feature", "bucket"], ["value"], {"upto": "n"})
        slots = [(p["feature"], p["bucket"], p["name"], p["end"], p["rank"]) for p in places]
        wanted = self.spark.createDataFrame(slots, "feature string, bucket int, name string, end string, rank long")
        inside = (F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
        found = ranked.join(F.broadcast(wanted), ["feature", "bucket"]).where(inside)  # two rows per column and quantile
        ends = {(r["feature"], r["name"], r["end"]): r["value"] for r in found.select("feature", "name", "end", "value").collect()}
        out: dict[str, dict[str, float]] = {}
        for p in places:
            lo, hi = (ends[p["feature"], p["name"], e] for e in ("lo", "hi"))
            out.setdefault(p["feature"], {})[p["name"]] = lo + (hi - lo) * p["part"] if lo != hi else lo
        return self.spark.createDataFrame([(c, *[v[n] for n in probabilities]) for c, v in out.items()], f"feature string, {names}")

    def historical(self) -> DataFrame:
        """``(feature, mean, median, std, min, max, q25, q75)``, the values of ``stats.historical_statistics`` of all rows."""
        cuts = self.quantiles({"q25": 0.25, "median": 0.5, "q75": 0.75})
        columns = ["feature", "mean", "median", "std", "min", "max", "q25", "q75"]
        return self.moments().join(F.broadcast(cuts), "feature", "left").select(*columns)  # one row per column

    def modes(self) -> DataFrame:
        """``(feature, mode)``: most frequent value, the smallest on a tie, upper-cased."""
        counts = self.journal.read("words").groupBy("feature", "value").agg(F.sum("n").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
        return counts.groupBy("feature").agg(F.upper(best["value"]).alias("mode"))

    def fill_values(self, training: dict | None = None) -> FillValues:
        """What ``stats.fit_fill_values`` gives for all rows."""
        medians = self.quantiles({"median": 0.5}).collect() if self.numeric else []
        modes = self.modes().collect() if self.text else []
        return FillValues(
            medians={r["feature"]: r["median"] for r in medians if not math.isnan(r["median"])},
            means={c: s["mean"] for c, s in (training or {}).items() if "mean" in s},
            modes={r["feature"]: r["mode"] for r in modes},
        )


def _moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, n, mean, squares, min, max)``: count, mean and squared deviations from it, in one pass."""
    made = {
        "n": F.count, "mean": F.avg, "squares": lambda c: F.var_pop(c) * F.count(c), "min": F.min, "max": F.max,
    }
    row = rows.agg(*[fn(quoted(c)).alias(f"{i}_{p}") for i, c in enumerate(columns) for p, fn in made.items()])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{p}").alias(p) for p in made]) for i, c in enumerate(columns)
    ])
    return row.select(F.inline(entries))
