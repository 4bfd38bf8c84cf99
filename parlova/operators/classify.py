"""Intent classifiers: linear scoring in SQL terms, and MLlib training."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlova.functions.arrays import softmax
from parlova.functions.text import ngrams
from parlova.operators.ranking import global_rank
from parlova.operators.vectors import Vocabulary, fit_vocabulary, gram_counts, tfidf_weights
from parlova.runtime import discard, materialize, scratch_scope
from parlova.schemas import OTHER_INTENT

# Thresholds and limits.
CONFIDENCE_THRESHOLD = 0.60
MAX_FEATURES = 20000
CALIBRATION_FOLDS = 3
# The library's default precision of the optimiser.
TOLERANCE = 1e-6
# Models hold a number per class and gram on the driver and in each row's class columns.
MAX_CLASSES = 1000


# --- linear model as tables ------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    """Coefficients (class, gram, coef): at most classes x vocabulary rows."""

    classes: list[str]
    vocabulary: Vocabulary
    coefficients: DataFrame
    scale: float


def centroid_model(train: DataFrame, max_features: int = 5000, scale: float = 10.0) -> LinearModel:
    """Class coefficients = mean TF-IDF vector of the class; train has (doc_id, text, intent)."""
    docs = train.where(F.col("intent").isNotNull())
    counts = materialize(gram_counts(docs.select("doc_id", "text")))
    fitted = fit_vocabulary(docs.count(), counts, max_features)
    vocabulary = Vocabulary(materialize(fitted.terms), max_features)
    model = centroid_model_of(tfidf_weights(counts, vocabulary), docs, vocabulary, scale)
    discard(counts)
    return model


def centroid_model_of(weights: DataFrame, labelled: DataFrame, vocabulary: Vocabulary, scale: float = 10.0) -> LinearModel:
    """The same from given weights (doc_id, gram, w), such as those of a retrieval index."""
    labels = labelled.where(F.col("intent").isNotNull()).select("doc_id", "intent")
    # One row per class reaches the driver.
    sizes = {r.intent: r.n for r in labels.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled rows to train on")
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"{len(sizes)} classes; at most {MAX_CLASSES} are supported")
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("intent"))
    coefficients = (
        weights.join(labels, "doc_id")
        .groupBy("intent", "gram")
        .agg(F.sum("w").alias("total"))
        .select(F.col("intent").alias("class"), "gram", (F.col("total") / size).alias("coef"))
    )
    return LinearModel(sorted(sizes), vocabulary, materialize(coefficients), scale)


def linear_probabilities(messages: DataFrame, model: LinearModel) -> DataFrame:
    """(qid, probs ARRAY<DOUBLE>) in the order of ``model.classes``; messages (qid, text).

    One aggregate column per class, so a gram is not multiplied by the classes.
    """
    per_gram = model.coefficients.groupBy("gram").agg(
        *[F.max(F.when(F.col("class") == c, F.col("coef"))).alias(f"c{i}") for i, c in enumerate(model.classes)]
    )
    weights = tfidf_weights(gram_counts(messages, "qid", "text"), model.vocabulary, "qid")
    sums = (
        weights.join(F.broadcast(per_gram), "gram")
        .groupBy("qid")
        .agg(*[F.sum(F.col("w") * F.coalesce(f"c{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(model.classes))])
    )
    logits = F.array(*[F.lit(model.scale) * F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(model.classes))])
    return messages.select("qid").join(sums, "qid", "left").select("qid", softmax(logits).alias("probs"))


def intent_top3(probs: Column, classes: list[str], threshold: float) -> tuple[Column, Column, Column]:
    """(intent, confidence, top3): best class unless below the threshold.

    ``top3`` is ARRAY<STRUCT<intent, score>>, best first, ties by name.
    """
    ranked = F.sort_array(
        F.zip_with(
            probs,
            F.array(*[F.lit(c) for c in classes]),
            lambda p, c: F.struct((-F.round(p, 9)).alias("key"), c.alias("intent"), p.alias("score")),
        )
    )
    best = F.get(ranked, F.lit(0))
    intent = F.when(best["score"] < threshold, OTHER_INTENT).otherwise(best["intent"])
    top3 = F.transform(F.slice(ranked, 1, 3), lambda r: F.struct(r["intent"].alias("intent"), r["score"].alias("score")))
    return intent, best["score"], top3


def with_intent(scored: DataFrame, classes: list[str], threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    intent, confidence, top3 = intent_top3(F.col("probs"), classes, threshold)
    return scored.withColumns({"intent": intent, "confidence": confidence, "top_intents": top3})


def threshold_sweep(predictions: DataFrame, steps: int = 20) -> DataFrame:
    """Precision and coverage per confidence threshold 0, 1/steps, …, 1.

    Each prediction counts once in its highest bin; running sums over the
    ``steps`` + 1 bins replace one row per threshold and prediction.
    """
    bin_no = F.least(F.floor(F.round(F.col("confidence") * steps, 9)), F.lit(steps)).cast("bigint")
    # An unknown confidence reaches no threshold.
    known = predictions.where("confidence IS NOT NULL AND NOT isnan(confidence)")
    bins = known.groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("intent") == F.col("true_intent")).alias("hits"),
    )
    total = predictions.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    grid = predictions.sparkSession.range(steps + 1).select(F.col("id").alias("bin"))
    upward = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(bins, "bin", "left")
        .na.fill(0, ["n", "hits"])
        .select(
            (F.col("bin") / steps).alias("threshold"),
            F.sum("n").over(upward).alias("n_kept"),
            F.sum("hits").over(upward).alias("n_correct"),
        )
        .withColumn("coverage", F.try_divide("n_kept", total))
        .withColumn("precision", F.try_divide("n_correct", "n_kept"))
    )


def chosen_threshold(predictions: DataFrame, target: float, steps: int = 1000, z: float = 1.645) -> DataFrame:
    """The lowest threshold of a sweep at which precision is at least ``target`` with confidence.

    One row (threshold, n_kept, n_correct, coverage, precision, lower_bound), all null where no threshold will
    do. The bound is Wilson's one-sided lower limit for the precision of the predictions that are kept; few of them
    give a low one, so a threshold is not chosen for a lucky handful. A null or NaN ``confidence`` counts
    in the coverage only.
    """
    n, p = F.col("n_kept"), F.col("precision")
    square = z * z
    spread = z * F.sqrt(p * (1 - p) / n + square / (4 * n * n))
    lower = F.when(n > 0, (p + square / (2 * n) - spread) / (1 + square / n))
    swept = threshold_sweep(predictions, steps).withColumn("lower_bound", lower)
    columns = ["threshold", "n_kept", "n_correct", "coverage", "precision", "lower_bound"]
    good = F.when(F.col("lower_bound") >= target, F.struct(*columns))
    return swept.agg(F.min(good).alias("best")).select("best.*")


def choose_threshold(predictions: DataFrame, target: float, steps: int = 1000, z: float = 1.645) -> float:
    """``chosen_threshold`` as a number for the configuration of the triage; above 1 where none will do, so all escalates."""
    found = chosen_threshold(predictions, target, steps, z).first().threshold
    return 2.0 if found is None else found


# --- trained models ---------------------------------------------------------


@dataclass(frozen=True)
class TextClassifier:
    """Features + multinomial logistic regression over uni- and bigrams, or over given features."""

    pipeline: PipelineModel
    classes: list[str]
    reads_text: bool = True

    def probabilities(self, messages: DataFrame) -> DataFrame:
        grams = messages.withColumn("grams", ngrams(F.col("text"))) if self.reads_text else messages
        return self.pipeline.transform(grams).select("qid", vector_to_array("probability").alias("probs"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        _save_classes(self.classes, path)


def _save_classes(classes: list[str], path: str) -> None:
    spark = SparkSession.active()
    names = spark.createDataFrame(list(enumerate(classes)), "class_no int, name string")
    names.write.mode("overwrite").parquet(f"{path}/classes")


def _load_classes(spark: SparkSession, path: str) -> list[str]:
    return [r.name for r in spark.read.parquet(f"{path}/classes").orderBy("class_no").collect()]


def load_text_classifier(spark: SparkSession, path: str, reads_text: bool = True) -> TextClassifier:
    return TextClassifier(PipelineModel.load(f"{path}/pipeline"), _load_classes(spark, path), reads_text)


def fit_text_features(train: DataFrame, max_features: int, min_df: int = 1) -> PipelineModel:
    """Counts of the vocabulary, times smoothed idf, then unit length.

    The vocabulary is that of ``fit_vocabulary``: the most frequent grams, ties by gram. Its at
    most ``max_features`` terms become the model's parameters.
    """
    grams = train.select("grams")
    counts = grams.select(F.monotonically_increasing_id().alias("_row"), F.explode("grams").alias("gram"))
    counts = counts.groupBy("_row", "gram").agg(F.count(F.lit(1)).alias("tf"))
    terms = fit_vocabulary(grams.count(), counts, max_features, min_df).terms.collect()
    if not terms:
        raise ValueError("no text to take a vocabulary from")
    scaling = Vectors.dense([t.idf for t in terms])
    return PipelineModel(
        [
            CountVectorizerModel.from_vocabulary([t.gram for t in terms], inputCol="grams", outputCol="tf"),
            ElementwiseProduct(scalingVec=scaling, inputCol="tf", outputCol="tfidf"),
            Normalizer(p=2.0, inputCol="tfidf", outputCol="features"),
        ]
    )


def _logistic(n_rows: int, max_iter: int, tolerance: float = TOLERANCE) -> LogisticRegression:
    # An L2 weight of 1 on the summed loss is 1/n on the mean loss.
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        family="multinomial",
        standardization=False,
        regParam=1.0 / max(n_rows, 1),
        maxIter=max_iter,
        tol=tolerance,
    )


def train_text_classifier(
    train: DataFrame, max_features: int = MAX_FEATURES, max_iter: int = 1000, tolerance: float = TOLERANCE
) -> TextClassifier:
    """Fit on (text, intent), or on (features, intent) if there are features."""
    with scratch_scope(train.sparkSession):
        labelled = train.where(F.col("intent").isNotNull())
        reads_text = "features" not in train.columns
        stages: list = []
        if reads_text:
            data = materialize(labelled.select("intent", ngrams(F.col("text")).alias("grams")))
            features = fit_text_features(data, max_features)
            stages, data = list(features.stages), features.transform(data)
        else:
            data = labelled
        indexer = StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc").fit(data)
        # Read by every pass of the optimiser: a stored table survives the loss of an executor.
        ready = materialize(indexer.transform(data).select("features", "label"))
        model = _logistic(ready.count(), max_iter, tolerance).fit(ready)
        return TextClassifier(PipelineModel([*stages, model]), list(indexer.labels), reads_text)


def stratified_folds(df: DataFrame, label_col: str, id_col: str, folds: int = CALIBRATION_FOLDS) -> DataFrame:
    """Fold number per row, balanced within each class: the rank in the class by a hash of the id.

    Ranks come from a range-partitioned sort of ids, so a class that holds most of the
    table is no single task. Ids must be unique.
    """
    slim = df.select(label_col, id_col, F.xxhash64(id_col).alias("_h"))
    ranked = global_rank(slim, [label_col, "_h", id_col], "_rank").rows
    first = ranked.groupBy(F.col(label_col).alias("_class")).agg(F.min("_rank").alias("_first"))
    place = F.pmod(F.col("_rank") - F.col("_first"), F.lit(folds)).cast("int")
    numbered = ranked.join(first, F.col(label_col) == F.col("_class")).select(F.col(id_col).alias("_id"), place.alias("fold"))
    return df.join(numbered, F.col(id_col) == F.col("_id")).drop("_id")


@dataclass(frozen=True)
class CalibratedClassifier:
    """Mean over folds of per-class sigmoid-calibrated logistic regressions."""

    features: PipelineModel | None
    models: list[LogisticRegressionModel]
    sigmoids: DataFrame  # (fold, class_no, a, b): folds x classes rows
    classes: list[str]

    def probabilities(self, messages: DataFrame) -> DataFrame:
        """(qid, probs) for messages with a features or text column."""
        data = messages
        if self.features is not None:
            data = self.features.transform(messages.withColumn("grams", ngrams(F.col("text"))))
        total = None
        for fold, model in enumerate(self.models):
            raw = model.setRawPredictionCol(f"_raw{fold}").setProbabilityCol("").setPredictionCol("")
            data = raw.transform(data)
            rows = self.sigmoids.where(F.col("fold") == fold)
            params = rows.agg(F.sort_array(F.collect_list(F.struct("class_no", "a", "b"))).alias("p"))
            # A column of its own: a subquery may not stand inside a higher-order function.
            data = data.withColumn(f"_fit{fold}", params.select("p").scalar())
            sig = F.zip_with(
                vector_to_array(F.col(f"_raw{fold}")),
                f"_fit{fold}",
                lambda m, p: 1.0 / (1.0 + F.exp(p["a"] * m + p["b"])),
            )
            summed = F.aggregate(sig, F.lit(0.0), lambda s, x: s + x)
            normed = F.transform(sig, lambda x: F.coalesce(F.try_divide(x, summed), F.lit(1.0 / len(self.classes))))
            total = normed if total is None else F.zip_with(total, normed, lambda x, y: x + y)
        n = float(len(self.models))
        return data.select("qid", F.transform(total, lambda x: x / n).alias("probs"))

    def save(self, path: str) -> None:
        for fold, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/fold={fold}")
        if self.features is not None:
            self.features.write().overwrite().save(f"{path}/features")
        self.sigmoids.write.mode("overwrite").parquet(f"{path}/sigmoids")
        _save_classes(self.classes, path)


def load_calibrated_classifier(spark: SparkSession, path: str, with_features: bool) -> CalibratedClassifier:
    sigmoids = spark.read.parquet(f"{path}/sigmoids")
    folds = sorted(r.fold for r in sigmoids.select("fold").distinct().collect())
    return CalibratedClassifier(
        PipelineModel.load(f"{path}/features") if with_features else None,
        [LogisticRegressionModel.load(f"{path}/fold={f}") for f in folds],
        sigmoids,
        _load_classes(spark, path),
    )


def fit_sigmoids(margins: DataFrame, max_steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """(fold, class_no, a, b) of p = 1 / (1 + exp(a·f + b)), all fits at once.

    ``margins`` has (fold, class_no, f, positive). Targets are smoothed as
    (n+ + 1)/(n+ + 2) and 1/(n- + 2). Every Newton step is one grouped
    aggregation; only folds x classes parameters reach the driver.
    """
    spark = margins.sparkSession
    groups = (
        margins.groupBy("fold", "class_no")
        .agg(F.count_if("positive").alias("n_pos"), F.count_if(~F.col("positive")).alias("n_neg"))
        .collect()
    )
    params = {(g.fold, g.class_no): (0.0, math.log((g.n_neg + 1.0) / (g.n_pos + 1.0))) for g in groups}
    targets = spark.createDataFrame(
        [(g.fold, g.class_no, (g.n_pos + 1.0) / (g.n_pos + 2.0), 1.0 / (g.n_neg + 2.0)) for g in groups],
        "fold int, class_no int, hi double, lo double",
    )
    data = margins.join(F.broadcast(targets), ["fold", "class_no"]).select(
        "fold", "class_no", "f", F.when(F.col("positive"), F.col("hi")).otherwise(F.col("lo")).alias("t")
    )

    def sums(trial: dict) -> dict:
        table = spark.createDataFrame(
            [(f, c, a, b) for (f, c), (a, b) in trial.items()], "fold int, class_no int, a double, b double"
        )
        z = F.col("a") * F.col("f") + F.col("b")
        p = 1.0 / (1.0 + F.exp(z))
        d = F.col("t") - p
        h = p * (1.0 - p)
        # -log p and -log(1-p) in terms of z without overflow.
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        rows = (
            data.join(F.broadcast(table), ["fold", "class_no"])
            .groupBy("fold", "class_no")
            .agg(
                F.sum(d * F.col("f")).alias("ga"),
                F.sum(d).alias("gb"),
                F.sum(h * F.col("f") * F.col("f")).alias("haa"),
                F.sum(h * F.col("f")).alias("hab"),
                F.sum(h).alias("hbb"),
                F.sum(softplus - (1.0 - F.col("t")) * z).alias("loss"),
            )
            .collect()
        )
        return {(r.fold, r.class_no): r for r in rows}

    current = sums(params)
    step_size = dict.fromkeys(params, 1.0)
    for _ in range(max_steps):
        trial, moved = {}, False
        for key, (a, b) in params.items():
            r = current[key]
            ridge = 1e-10
            det = (r.haa + ridge) * (r.hbb + ridge) - r.hab * r.hab
            da = -((r.hbb + ridge) * r.ga - r.hab * r.gb) / det if det else 0.0
            db = -((r.haa + ridge) * r.gb - r.hab * r.ga) / det if det else 0.0
            s = step_size[key]
            trial[key] = (a + s * da, b + s * db)
            moved = moved or max(abs(s * da), abs(s * db)) > tolerance
        if not moved:
            break
        proposed = sums(trial)
        for key in params:
            if proposed[key].loss <= current[key].loss + 1e-12:
                params[key], current[key], step_size[key] = trial[key], proposed[key], 1.0
            else:
                step_size[key] /= 2.0
    return spark.createDataFrame(
        [(f, c, a, b) for (f, c), (a, b) in sorted(params.items())], "fold int, class_no int, a double, b double"
    )


def train_calibrated(
    train: DataFrame,
    max_features: int = 5000,
    max_iter: int = 2000,
    folds: int = CALIBRATION_FOLDS,
    tolerance: float = TOLERANCE,
) -> CalibratedClassifier | TextClassifier:
    """Fit on (doc_id, text or features, intent).

    With a class smaller than ``folds`` the calibration is left out and a plain
    classifier is returned.
    """
    labelled = train.where(F.col("intent").isNotNull())
    smallest = labelled.groupBy("intent").count().agg(F.min("count")).first()[0]
    if smallest is None:
        raise ValueError("no labelled rows to train on")
    has_features = "features" in train.columns
    if smallest < folds:
        return train_text_classifier(labelled, max_features, max_iter, tolerance)
    features = None
    data = labelled
    if not has_features:
        grams = labelled.withColumn("grams", ngrams(F.col("text")))
        features = fit_text_features(grams, max_features)
        data = features.transform(grams)
    indexer = StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc").fit(labelled)
    data = stratified_folds(indexer.transform(data), "intent", "doc_id", folds).select("doc_id", "features", "label", "fold")
    with scratch_scope(train.sparkSession):
        data = materialize(data)
        n = data.count()
        models, held_out = [], None
        for fold in range(folds):
            model = _logistic(n - n // folds, max_iter, tolerance).fit(data.where(F.col("fold") != fold))
            models.append(model)
            margins = (
                model.transform(data.where(F.col("fold") == fold))
                .select("label", "fold", F.posexplode(vector_to_array("rawPrediction")).alias("class_no", "f"))
                .select("fold", "class_no", "f", (F.col("label") == F.col("class_no")).alias("positive"))
            )
            held_out = margins if held_out is None else held_out.unionByName(margins)
        sigmoids = fit_sigmoids(materialize(held_out))
        return CalibratedClassifier(features, models, sigmoids, list(indexer.labels))
