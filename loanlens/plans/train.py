"""Training data, model fitting and retraining."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens import session
from loanlens.functions.names import quote, quoted
from loanlens.operators import encode as E
from loanlens.operators import evaluate as V
from loanlens.operators import impute as I
from loanlens.operators import mapping as M
from loanlens.operators.split import fold, split_stratified
from loanlens.operators.stats import numeric_columns
from loanlens.session import in_even_parts, materialize, outgrows_cores, shared_dir

BOOSTED = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42}
FOREST = {"numTrees": 100, "seed": 42}
#: Rows a leaf needs. Boosting libraries ask for a weight of 1, and a row of a logistic loss weighs at most 1/4.
LEAST_ROWS = 4


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    metrics: dict
    train_rows: int
    test_rows: int
    details: dict


def union_training_sources(feedback: DataFrame, original: DataFrame | None) -> DataFrame:
    """Feedback rows and the original dataset, columns unified, duplicates kept."""
    return feedback if original is None else feedback.unionByName(original, allowMissingColumns=True)


def stored_feature_schema(rows: DataFrame, name: str = "input_features") -> T.StructType:
    """The application's columns and all further keys of the stored JSON texts (one row per key is collected, in one pass)."""
    known = [*S.APPLICATION_SCHEMA.names, *S.TARGETS]
    kinds = {r["feature"]: r["kind"] for r in M.feature_kinds(rows, name).where(~F.col("feature").isin(known)).collect()}
    found = {"double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([*S.APPLICATION_SCHEMA.fields, *(T.StructField(c, found[kinds[c]]) for c in sorted(kinds))])


def extract_training_data(predictions: DataFrame, original: DataFrame | None = None,
                          schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """Feature columns, ``row_key`` and ``loan_status`` of all rows with a known outcome.

    Without a ``schema`` the columns are the application's and every other key that some stored row holds; such a
    column is double if all its values are numbers, else text. An original row whose label is no number is left out.
    """
    known = predictions.where(F.col("actual_outcome").isNotNull() & F.col("input_features").isNotNull())
    if schema is None:
        schema = stored_feature_schema(known)
    if limit is not None:
        known = known.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    # all keys as text first: a number in quotes is a number
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    feedback = M.unpack_features(
        known.select(
            F.concat(F.lit("p"), F.col("id").cast("string")).alias("row_key"), "input_features",
            F.col("actual_outcome").cast("int").alias("loan_status"),
        ), texts,
    ).withColumns({f.name: quoted(f.name).try_cast(f.dataType) for f in schema})
    if original is None:
        return feedback
    status = next((c for c in ("loan_status", "loan_status_num") if c in original.columns), None)
    if status is None:
        return feedback
    labelled = original.withColumn("loan_status", F.col(status).cast("string").try_cast("double").try_cast("int")).where(F.col("loan_status").isNotNull())
    others = [c for c in S.TARGETS if c != "loan_status"]
    return union_training_sources(feedback, M.rename_original_dataset(labelled).drop(*others))


def prepare_features(df: DataFrame, keep: list[str] = (), categories: dict | None = None,
                     accuracy: int | None = None) -> tuple[DataFrame, list[str]]:
    """Numeric columns median-filled, others UNKNOWN-filled, upper-cased and one-hot encoded."""
    kept = df.select(*keep, *[F.col(f"`{c}`") for c in M.drop_targets(df.drop(*keep)).columns])
    features = [c for c in kept.columns if c not in keep]
    numbers = [c for c in numeric_columns(kept) if c in features]
    texts = [c for c in features if c not in numbers]
    filled = I.impute_train_median(kept, numbers, I.train_medians(kept, numbers, accuracy))
    filled = I.fill_residual_zero(I.impute_train_unknown(filled, texts), numbers)
    found = categories or E.categories(filled, texts)
    encoded = E.one_hot_dynamic(filled, found)
    names = [c for c in encoded.columns if c not in keep]
    return encoded, names


@dataclass
class Inputs:
    """What a model reads of a raw frame: numbers with the fill of their nulls, and texts with their categories."""

    numbers: dict[str, float]
    texts: dict[str, list[str]]
    upper: bool = False

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *(f"{c}_{v}" for c, vs in self.texts.items() for v in vs)]

    def _text(self, column: str) -> str:
        filled = f"coalesce(CAST({quote(column)} AS STRING), 'UNKNOWN')"
        return f"upper({filled})" if self.upper else filled

    def select(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Filled inputs under the names ``n0, ...`` and ``t0, ...``, so that no name of the frame meets another rule."""
        numbers = [F.coalesce(quoted(c).try_cast("double"), F.lit(fill)).alias(f"n{i}") for i, (c, fill) in enumerate(self.numbers.items())]
        return df.select(*keep, *numbers, *[F.expr(self._text(c)).alias(f"t{i}") for i, c in enumerate(self.texts)])

    def stages(self, train: DataFrame) -> list:
        """Raw frame to ``features``: numbers filled and scaled, categories as one sparse block, scaled without centring.

        The scales are those of ``train``. All helper columns go again.
        """
        places = [f"n{i}" for i in range(len(self.numbers))]
        known = self.select(train, [])
        scaler = E.Scaler.fit(known, places) if places else E.Scaler({}, {})
        numbers = [
            f"(coalesce(try_cast({quote(c)} AS DOUBLE), {fill!r}D) - ({scaler.mean[n]!r}D)) / {scaler.std[n]!r}D AS z{i}__z"
            for i, (n, (c, fill)) in enumerate(zip(places, self.numbers.items()))
        ]
        marked = {f"t{i}__t": vs for i, vs in enumerate(self.texts.values())}
        texts = [f"concat('=', {self._text(c)}) AS {t}" for c, t in zip(self.texts, marked)]
        flags = E.flag_stages(marked, "flags__f")
        read = SQLTransformer(statement="SELECT " + ", ".join(["*", *numbers, *texts]) + " FROM __THIS__")
        made, blocks = [f"z{i}__z" for i in range(len(numbers))], []
        if flags:
            blocks = [StandardScaler(inputCol="flags__f", outputCol="scaled__f", withMean=False)]
            made.append("scaled__f")
        if not made:
            raise ValueError("no feature: no numeric column, and no category that enough rows hold")
        pipeline = Pipeline(stages=[read, *flags, *blocks, VectorAssembler(inputCols=made, outputCol="features")]).fit(train)
        helpers = {*made, *marked} | ({"flags__f", *(f"{t}__{k}" for t, vs in marked.items() if vs for k in ("index", "flags"))} if flags else set())
        return [*pipeline.stages, SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(sorted(helpers))}) FROM __THIS__")]


def fit_inputs(df: DataFrame, numbers: list[str], texts: list[str], upper: bool = False, least: int = 1) -> Inputs:
    """Medians of the numbers (0 without any) and sorted categories of the texts; null texts are ``UNKNOWN``."""
    bare = Inputs(dict.fromkeys(numbers, 0.0), dict.fromkeys(texts, []), upper)
    raw = df.select(*[quoted(c).try_cast("double").alias(f"n{i}") for i, c in enumerate(numbers)])
    medians = I.train_medians(raw, raw.columns)
    found = E.categories(bare.select(df, []), [f"t{i}" for i in range(len(texts))], least)
    return Inputs({c: float(medians.get(f"n{i}", 0.0)) for i, c in enumerate(numbers)}, dict(zip(texts, found.values())), upper)


def fit_boosted_trees(train: DataFrame, features: list[str] | Inputs, label: str = "label", params: dict | None = None) -> PipelineModel:
    """Scale, assemble and boost; the fitted pipeline holds inputs, scales, feature order and trees.

    ``features`` names numeric columns, or holds inputs of both kinds. Scaling changes no tree: a split keeps its rows.
    """
    shared_dir(train.sparkSession)  # checkpoints of long boosting runs go to the shared folder
    inputs = features if isinstance(features, Inputs) else Inputs(dict.fromkeys(features, 0.0), {})
    prepared = PipelineModel(inputs.stages(train))
    frame = prepared.transform(train).select("features", quoted(label).cast("double").alias(label))
    # every level of every tree is a job over all tasks of the frame
    frame = in_even_parts(materialize(frame, "even")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = GBTClassifier(
            featuresCol="features", labelCol=label, checkpointInterval=10, **(BOOSTED | (params or {}))
        ).fit(frame)
    finally:
        frame.unpersist()
    return PipelineModel([*prepared.stages, trees])


def forest_pipeline(numeric: list[str], text: list[str], label: str = "label", params: dict | None = None) -> Pipeline:
    """Scaled numerics and one-hot categories (an unseen one is all zeros) into a random forest."""
    index = [f"{c}__i" for c in text]
    onehot = [f"{c}__h" for c in text]
    stages = [
        StringIndexer(inputCols=text, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=onehot, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=numeric, outputCol="numbers__v"),
        StandardScaler(inputCol="numbers__v", outputCol="numbers__z", withMean=True),
        VectorAssembler(inputCols=["numbers__z", *onehot], outputCol="features"),
        RandomForestClassifier(labelCol=label, featuresCol="features", **(FOREST | (params or {}))),
    ]
    return Pipeline(stages=stages)


def kfold_cv(df: DataFrame, pipeline: Pipeline, key: str, label: str = "label", folds: int = 5, seed: int = 42):
    """``(accuracy per fold, mean)``; folds come from a hash of the row id.

    All folds read one written frame. The folds of a small one run side by side, so that their small stages do not leave cores
    idle; those of a large one run one by one, in bounded tasks, and share no memory.
    """
    folded = materialize(df.withColumn("_fold", fold(key, folds, seed)), "folds")
    at_once = folds_at_once(folded, folds)
    if outgrows_cores(folded):
        folded = in_even_parts(folded).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def one(i: int) -> float:
        model = pipeline.fit(folded.where(F.col("_fold") != i))
        return evaluator.evaluate(model.transform(folded.where(F.col("_fold") == i)))

    try:
        with ThreadPoolExecutor(at_once) as pool:
            scores = list(pool.map(one, range(folds)))
    finally:
        folded.unpersist()
    return scores, sum(scores) / len(scores)


def folds_at_once(rows: DataFrame, folds: int) -> int:
    """How many folds the cores hold with at most ``TASK_ROWS`` rows each, at least one."""
    return min(folds, max(1, rows.sparkSession.sparkContext.defaultParallelism * session.TASK_ROWS // max(rows.count(), 1)))


def evaluate_model(scored: DataFrame, label: str = "label") -> dict:
    """Confusion metrics and AUC of a scored frame (``prediction``, ``probability`` vector)."""
    pairs = scored.select(label, "prediction", vector_to_array("probability")[1].alias("probability"), "rawPrediction")
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metrics = V.binary_metrics(pairs, label).first().asDict()
        auc = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0).evaluate(pairs)
    finally:
        pairs.unpersist()
    return {**metrics, "auc_roc": auc}


def train_and_evaluate(frame: DataFrame, inputs: Inputs, key: str, label: str, test_size: float = 0.2,
                       seed: int = 42, params: dict | None = None, details: dict | None = None) -> Trained:
    """Stratified split, fit on the training part, metrics on the test part."""
    frame = frame.withColumn(label, F.col(label).cast("int"))
    divided = materialize(split_stratified(frame, key, label, test_size, seed), "training")
    train, test = divided.where(~F.col("is_test")), divided.where(F.col("is_test"))
    sizes = divided.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).first()
    model = fit_boosted_trees(train, inputs, label, {"seed": seed, "minInstancesPerNode": LEAST_ROWS, **(params or {})})
    metrics = evaluate_model(model.transform(test), label)
    return Trained(model, inputs.features, metrics, sizes.train, sizes.test, details or {})


def train_flexible(df: DataFrame, key: str, columns: dict | None = None, test_size: float = 0.2, seed: int = 42,
                   params: dict | None = None, store=None, on_unmapped: str = "zero") -> Trained:
    """Train on any frame: find target and column kinds, prepare, fit, evaluate, and save if a store is given.

    Names and categories may hold any characters, and categories have no limit: one that fewer rows hold than a leaf needs
    (``LEAST_ROWS``) can split nothing and has no place in the vector. The model reads the raw frame. Missing numbers
    take the median, missing texts ``UNKNOWN``. Trees bin every place for every row, so their memory grows with rows times
    places.
    """
    if columns:
        df = df.select(*[quoted(c) for c in dict.fromkeys((key, columns["target"], *columns["numeric"], *columns["categorical"]))])
    df = materialize(df, "training")  # read by every step below, computed once
    found = columns or E.detect_columns(df.drop(key))
    data = E.map_target(df, found["target"], "label__", on_unmapped).drop("label___unmapped")
    numbers, texts = found["numeric"], found["categorical"]
    data = data.select(quoted(key), "label__", *[quoted(c) for c in (*numbers, *texts)])
    least = (params or {}).get("minInstancesPerNode", LEAST_ROWS)
    inputs = fit_inputs(data, numbers, texts, least=least)
    features = inputs.features
    details = {
        "target_column": found["target"], "numeric_features": numbers, "categorical_features": texts,
        "feature_names": features, "n_features": len(features),
    }
    result = train_and_evaluate(data, inputs, key, "label__", test_size, seed, params, details)
    result.details["n_samples"] = result.train_rows + result.test_rows
    if store is not None:
        result.details["version"] = store.save(result.model, features, result.metrics, source="flexible_training")
    return result


def retrain(predictions: DataFrame, original: DataFrame | None = None, min_samples: int = 100,
            min_feedback_ratio: float = 0.1, test_size: float = 0.2, params: dict | None = None, store=None) -> dict:
    """Retrain from logged predictions with outcomes, and the original dataset if given.

    Without the original dataset the readiness gate must pass. ``original`` needs a ``row_key``.
    """
    outcome = F.col("actual_outcome")
    needed = {"id": F.col("id"), "input_features": F.when(outcome.isNotNull(), F.col("input_features")), "actual_outcome": outcome}
    # read by the gate, the search for keys and the extraction, computed once
    predictions = materialize(predictions.select(*[v.alias(c) for c, v in needed.items() if c in predictions.columns]), "predictions")
    ready = V.retraining_readiness(predictions, min_samples, min_feedback_ratio).first().asDict()
    if original is None and not ready["is_ready"]:
        return {"status": "insufficient_data", "readiness": ready, "training_samples": 0, "test_samples": 0}
    # read several times below (medians, categories, split), parsed once
    rows = materialize(extract_training_data(predictions, original), "training")
    if rows.isEmpty():
        raise ValueError("no training data: neither feedback rows nor an original dataset")
    rows = rows.withColumn("label__", F.col("loan_status"))
    names = M.drop_targets(rows.drop("row_key", "label__")).columns
    numbers = [c for c in numeric_columns(rows) if c in names]
    least = (params or {}).get("minInstancesPerNode", LEAST_ROWS)
    inputs = fit_inputs(rows, numbers, [c for c in names if c not in numbers], upper=True, least=least)
    features = inputs.features
    result = train_and_evaluate(rows, inputs, "row_key", "label__", test_size, params=params)
    version = None
    if store is not None:
        version = store.save(result.model, features, result.metrics, source="database_retraining")
    return {
        "status": "success", "readiness": ready, "metrics": result.metrics, "training_samples": result.train_rows,
        "test_samples": result.test_rows, "features_count": len(features), "model_version": version,
        "result": result,
    }
