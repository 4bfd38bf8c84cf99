"""Queries on labels, vectors, clusters and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlova.functions import text as tx
from parlova.operators import classify, cluster, labels
from parlova.operators.vectors import fit_vocabulary, gram_counts, tfidf_weights
from parlova.plans import sqlviews as sv
from parlova.plans.registry import query
from parlova.plans.sqlviews import VIEW_THRESHOLD, sql
from parlova.runtime import materialize
from parlova.sources import views
from parlova.sources.views import VIEW_RISKY, VIEW_RULES, VIEW_SENSITIVE

# --- labels --------------------------------------------------------------------


@query(
    "keyword_weak_label",
    f"SELECT doc_id, {sv.keyword_label('text', VIEW_RULES)} AS invented, {sv.keyword_label('text', labels.KEYWORD_RULES)} AS standard FROM documents",
)
def keyword_weak_label(spark, sf):
    text = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", labels.weak_label(text, VIEW_RULES).alias("invented"), labels.weak_label(text).alias("standard")
    )


@query("keyword_label_counts", sql("SELECT intent, count(*) AS n FROM pairs_v GROUP BY intent"))
def keyword_label_counts(spark, sf):
    return labels.label_distribution(views.pairs(spark, sf))


@query(
    "keyword_rule_hits",
    sql(
        " UNION ALL ".join(
            f"SELECT {sv.lit(label)} AS rule, count(*) FILTER ({' OR '.join(f'contains(lower(cleaned_text), {sv.lit(w)})' for w in words)}) AS n_hits, "
            f"count(*) FILTER (intent = {sv.lit(label)}) AS n_first FROM pairs_v"
            for label, words in VIEW_RULES
        )
    ),
)
def keyword_rule_hits(spark, sf):
    """How often each rule matches and how often it is the first to match."""
    text = F.lower(F.col("cleaned_text"))
    aggs = []
    for label, words in VIEW_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        aggs += [F.count_if(hit).alias(f"{label}:hits"), F.count_if(F.col("intent") == label).alias(f"{label}:first")]
    one = views.pairs(spark, sf).agg(*aggs)
    rows = [
        F.struct(F.lit(label).alias("rule"), F.col(f"`{label}:hits`").alias("n_hits"), F.col(f"`{label}:first`").alias("n_first"))
        for label, _ in VIEW_RULES
    ]
    return one.select(F.inline(F.array(*rows)))


@query("risk_keyword_hit", sql(f"SELECT conversation_id, {sv.first_keyword('cleaned_text', VIEW_RISKY)} AS risky, {sv.first_keyword('cleaned_text', VIEW_SENSITIVE)} AS sensitive FROM pairs_v"))
def risk_keyword_hit(spark, sf):
    text = F.col("cleaned_text")
    return views.pairs(spark, sf).select(
        "conversation_id",
        tx.first_keyword(text, VIEW_RISKY).alias("risky"),
        tx.first_keyword(text, VIEW_SENSITIVE).alias("sensitive"),
    )


_CLUSTER_NAMES = [(0, "PAYMENT_ISSUE"), (1, "REFUND_REQUEST"), (2, "CANCELLATION"), (3, "TECHNICAL_PROBLEM"), (5, "PRODUCT_INFORMATION"), (99, "LOGIN_OR_ACCOUNT")]
_CLUSTER_SQL = "(VALUES " + ", ".join(f"({c}, '{i}')" for c, i in _CLUSTER_NAMES) + ") m(cluster, intent)"


def _clusters(spark, sf):
    return views.vectors(spark, sf).select("vec_id", "label"), spark.createDataFrame(_CLUSTER_NAMES, "cluster int, intent string")


@query(
    "cluster_to_intent",
    f"SELECT vec_id, coalesce(m.intent, 'OTHER_OR_UNKNOWN') AS intent FROM embeddings e LEFT JOIN {_CLUSTER_SQL} ON m.cluster = e.label",
)
def cluster_to_intent(spark, sf):
    rows, mapping = _clusters(spark, sf)
    return labels.cluster_to_intent(rows, "label", mapping).select("vec_id", "intent")


@query("unmapped_clusters", f"SELECT DISTINCT label AS cluster FROM embeddings WHERE label NOT IN (SELECT cluster FROM {_CLUSTER_SQL})")
def unmapped_clusters(spark, sf):
    rows, mapping = _clusters(spark, sf)
    return labels.unmapped_clusters(rows, "label", mapping)


def _train(spark, sf):
    return views.flow(spark, sf)[1].where(F.col("split") == "train")


@query("label_distribution", sql("SELECT intent, count(*) AS n FROM splits_v WHERE split = 'train' GROUP BY intent"))
def label_distribution(spark, sf):
    return labels.label_distribution(_train(spark, sf))


@query("majority_label", sql("SELECT intent, count(*) AS n FROM splits_v WHERE split = 'train' GROUP BY intent ORDER BY n DESC, intent LIMIT 1"))
def majority_label(spark, sf):
    return labels.majority_label(_train(spark, sf))


@query(
    "min_class_count",
    sql("SELECT min(n) AS min_class_count, min(n) >= 3 AS can_calibrate FROM (SELECT count(*) AS n FROM splits_v WHERE split = 'train' GROUP BY intent)"),
)
def min_class_count(spark, sf):
    return labels.min_class_count(_train(spark, sf))


# --- vectors and clusters --------------------------------------------------------


@query("tfidf_weights", sql("SELECT doc_id, gram, round(w, 6) AS w FROM doc_tfidf_v"))
def tfidf_weights_query(spark, sf):
    docs = _train(spark, sf).select(F.col("pair_seq").alias("doc_id"), F.col("cleaned_text").alias("text"))
    counts = materialize(gram_counts(docs))
    weights = tfidf_weights(counts, fit_vocabulary(docs.count(), counts))
    return weights.select("doc_id", "gram", F.round("w", 6).alias("w"))


@query("centroids", sql("SELECT label, pos - 1 AS pos, round(mean, 6) AS mean FROM centroids_v"))
def centroids(spark, sf):
    rows = cluster.centroids(views.vectors(spark, sf), "label")
    return rows.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


def _nearest(spark, sf):
    rows = views.vectors(spark, sf)
    centers = cluster.centroid_vectors(cluster.centroids(rows, "label"))
    return cluster.nearest_centroid(rows, centers)


@query("nearest_centroid", sql("SELECT * FROM predicted_v"))
def nearest_centroid(spark, sf):
    return _nearest(spark, sf).select("vec_id", "label", "predicted")


@query(
    "cluster_representatives",
    sql(
        """SELECT label, rank, vec_id FROM (SELECT v.label, v.vec_id,
  row_number() OVER (PARTITION BY v.label ORDER BY round(list_distance(v.vec, c.centroid), 9), v.vec_id) AS rank
FROM vectors_v v JOIN centroid_vectors_v c USING (label)) WHERE rank <= 5"""
    ),
)
def cluster_representatives(spark, sf):
    return cluster.cluster_representatives(views.vectors(spark, sf), "label", 5)


def _silhouette_sql(distance):
    return sql(
        f"""SELECT round(avg(CASE WHEN own_n <= 1 THEN 0 ELSE (other - own / (own_n - 1)) / greatest(other, own / (own_n - 1)) END), 6) AS silhouette FROM (
  SELECT vec_id, max(CASE WHEN label = cluster THEN total END) AS own, max(CASE WHEN label = cluster THEN n END) AS own_n,
    min(CASE WHEN label <> cluster THEN total / n END) AS other
  FROM (SELECT a.vec_id, a.label, b.label AS cluster, sum({distance}) AS total, count(*) AS n
        FROM vectors_v a CROSS JOIN vectors_v b GROUP BY a.vec_id, a.label, b.label) GROUP BY vec_id)"""
    )


@query("silhouette_exact", _silhouette_sql("list_distance(a.vec, b.vec)"))
def silhouette_exact(spark, sf):
    return cluster.silhouette_exact(views.vectors(spark, sf), "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("silhouette_fast", _silhouette_sql("pow(list_distance(a.vec, b.vec), 2)"))
def silhouette_fast(spark, sf):
    return cluster.silhouette_fast(views.vectors(spark, sf), "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    """Cluster sizes, exact silhouette and the nearest members of the best of ten fits."""
    rows = views.vectors(spark, sf).select("vec_id", "vec")
    fit = cluster.fit_kmeans(rows, 8, n_init=10, seed=42)
    assigned = materialize(cluster.assign_kmeans(rows, fit))
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    nearest = cluster.cluster_representatives(assigned, "cluster", 1).select(F.col("label").alias("cluster"), "vec_id")
    score = cluster.silhouette_exact(assigned, "cluster").select("silhouette").scalar()
    return sizes.join(nearest, "cluster").withColumns({"silhouette": score, "cost": F.lit(fit.cost)})


@query("discover_intents")
def discover_intents(spark, sf):
    """Clusters of all customer messages: nearest members and silhouette."""
    docs = views.pairs(spark, sf).select(F.col("pair_seq").alias("vec_id"), F.col("cleaned_text").alias("text"))
    found = cluster.discover_text_clusters(materialize(docs), n_init=10)
    sizes = found.assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return found.representatives.join(sizes, "cluster").select(
        "cluster", "n", "rank", "vec_id", F.md5("text").alias("text"), found.silhouette.select("silhouette").scalar().alias("silhouette")
    )


# --- classifiers -----------------------------------------------------------------


def _scored(spark, sf, split="test"):
    splits = views.flow(spark, sf)[1]
    model = classify.centroid_model(views.training_rows(splits))
    messages = views.messages_of(splits, split)
    return messages, model, classify.linear_probabilities(messages.select("qid", "text"), model)


@query("linear_score_softmax", sql("SELECT qid, class, round(prob, 6) AS prob FROM m_probs_v"))
def linear_score_softmax(spark, sf):
    _, model, scored = _scored(spark, sf)
    named = F.arrays_zip(F.array(*[F.lit(c) for c in model.classes]).alias("class"), F.col("probs").alias("prob"))
    return scored.select("qid", F.inline(named)).toDF("qid", "class", "prob").withColumn("prob", F.round("prob", 6))


@query(
    "intent_top3_gate",
    sql("SELECT qid, intent, round(confidence, 6) AS confidence, top_intents, round(second, 6) AS second, round(third, 6) AS third FROM m_intent_v"),
)
def intent_top3_gate(spark, sf):
    _, model, scored = _scored(spark, sf)
    top = F.col("top_intents")
    return classify.with_intent(scored, model.classes, VIEW_THRESHOLD).select(
        "qid",
        "intent",
        F.round("confidence", 6).alias("confidence"),
        F.array_join(F.transform(top, lambda t: t["intent"]), "|").alias("top_intents"),
        F.round(F.get(top, F.lit(1))["score"], 6).alias("second"),
        F.round(F.get(top, F.lit(2))["score"], 6).alias("third"),
    )


# The sweep runs on the validation split.
sv.define("val_messages_v", "SELECT pair_seq AS qid, customer_text AS message, cleaned_text AS text, intent FROM splits_v WHERE split = 'val'")
for _n, _body in sv._per_query("val_messages_v", "v", 0.0).items():
    sv.define(_n, _body)


@query(
    "threshold_sweep",
    sql(
        """SELECT t / 20.0::DOUBLE AS threshold, count(p.qid) AS n_kept, count(p.qid) FILTER (p.best_intent = m.intent) AS n_correct,
  round(count(p.qid) / CAST((SELECT count(*) FROM v_intent_v) AS DOUBLE), 6) AS coverage,
  round(count(p.qid) FILTER (p.best_intent = m.intent) / CAST(nullif(count(p.qid), 0) AS DOUBLE), 6) AS precision
FROM (SELECT unnest(range(21)) AS t) LEFT JOIN v_intent_v p ON round(p.confidence * 20, 9) >= t
LEFT JOIN val_messages_v m ON m.qid = p.qid GROUP BY t"""
    ),
)
def threshold_sweep(spark, sf):
    messages, model, scored = _scored(spark, sf, "val")
    predicted = classify.with_intent(scored, model.classes, 0.0).join(
        messages.select("qid", F.col("intent").alias("true_intent")), "qid"
    )
    out = classify.threshold_sweep(predicted, 20)
    return out.withColumns({"coverage": F.round("coverage", 6), "precision": F.round("precision", 6)})


@query("train_text_lr")
def train_text_lr(spark, sf):
    """Logistic regression on TF-IDF, applied to the test messages."""
    splits = views.flow(spark, sf)[1]
    model = classify.train_text_classifier(views.training_rows(splits))
    scored = model.probabilities(views.messages_of(splits).select("qid", "text"))
    return classify.with_intent(scored, model.classes, 0.0).select("qid", "intent", "confidence")


@query("train_calibrated_lr")
def train_calibrated_lr(spark, sf):
    """Three-fold calibrated logistic regression, applied to the test messages."""
    splits = views.flow(spark, sf)[1]
    model = classify.train_calibrated(views.training_rows(splits))
    scored = model.probabilities(views.messages_of(splits).select("qid", "text"))
    return classify.with_intent(scored, model.classes, 0.0).select("qid", "intent", "confidence")


# --- checks of what SQL cannot repeat ---------------------------------------------------


@query(
    "kmeans_fit_checks",
    sql("SELECT count(*) AS n_vectors, 0 AS n_not_nearest, true AS sizes_add_up, true AS cost_repeats FROM embeddings"),
)
def kmeans_fit_checks(spark, sf):
    """Each vector lies in the cluster of its nearest centre, and the cost is that of the assignment."""
    rows = views.vectors(spark, sf).select("vec_id", "vec")
    fit = cluster.fit_kmeans(rows, 8, n_init=10, seed=42)
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(fit.centers)], "label int, centroid array<double>"
    )
    assigned = materialize(cluster.nearest_centroid(cluster.assign_kmeans(rows, fit).select("vec_id", "vec", "cluster"), centers))
    near = assigned.join(F.broadcast(centers), F.col("cluster") == F.col("label"))
    square = F.aggregate(F.zip_with("vec", "centroid", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    n = assigned.count()
    sizes = assigned.groupBy("cluster").count().agg(F.sum("count")).first()[0]
    return near.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(F.col("predicted") != F.col("cluster")).alias("n_not_nearest"),
        F.lit(sizes == n).alias("sizes_add_up"),
        (F.abs(F.sum(square) - fit.cost) <= 1e-6 * F.lit(max(1.0, fit.cost))).alias("cost_repeats"),
    )


@query(
    "discover_intents_checks",
    sql("SELECT count(*) AS n_texts, true AS sizes_add_up, 0 AS n_bad_ranks, true AS silhouette_in_range FROM pairs_v"),
)
def discover_intents_checks(spark, sf):
    """Cluster sizes, ranks of the examples and the range of the silhouette."""
    rows = discover_intents(spark, sf)
    sizes = rows.select("cluster", "n").distinct().agg(F.sum("n")).first()[0]
    return rows.agg(
        F.lit(sizes).cast("bigint").alias("n_texts"),
        F.lit(sizes == views.pairs(spark, sf).count()).alias("sizes_add_up"),
        F.count_if(~F.col("rank").between(1, F.least(F.lit(5), F.col("n")))).alias("n_bad_ranks"),
        F.max(F.abs("silhouette") <= 1).alias("silhouette_in_range"),
    )


_SCORED_SQL = """SELECT (SELECT count(*) FROM messages_v) AS n_messages, 0 AS n_bad_sums, 0 AS n_bad_ranges, 0 AS n_not_best"""


def _probability_checks(scored, classes):
    named = classify.with_intent(scored, classes, 0.0)
    total = F.aggregate("probs", F.lit(0.0), lambda s, x: s + x)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("intent"))
    return named.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.abs(total - 1.0) > 1e-6).alias("n_bad_sums"),
        F.count_if(F.exists("probs", lambda p: (p < 0) | (p > 1))).alias("n_bad_ranges"),
        F.count_if(F.round(F.element_at("probs", index.cast("int")), 9) < F.round(F.array_max("probs"), 9)).alias("n_not_best"),
    )


@query("train_text_lr_checks", sql(_SCORED_SQL))
def train_text_lr_checks(spark, sf):
    """Probabilities of the trained model sum to 1 and its label is the largest."""
    splits = views.flow(spark, sf)[1]
    model = classify.train_text_classifier(views.training_rows(splits))
    return _probability_checks(materialize(model.probabilities(views.messages_of(splits).select("qid", "text"))), model.classes)


@query("train_calibrated_lr_checks", sql(_SCORED_SQL))
def train_calibrated_lr_checks(spark, sf):
    """The same for the calibrated model."""
    splits = views.flow(spark, sf)[1]
    model = classify.train_calibrated(views.training_rows(splits))
    return _probability_checks(materialize(model.probabilities(views.messages_of(splits).select("qid", "text"))), model.classes)


VIEW_TARGET = 0.5
_Z = 1.645
sv.define(
    "thresholds_v",
    f"""SELECT *, (precision + {_Z} * {_Z} / (2 * n_kept) - {_Z} * sqrt(precision * (1 - precision) / n_kept + {_Z} * {_Z} / (4.0 * n_kept * n_kept))) / (1 + {_Z} * {_Z} / n_kept) AS lower_bound
FROM (SELECT t / 1000.0::DOUBLE AS threshold, count(*) AS n_kept, count(*) FILTER (p.best_intent = m.intent) AS n_correct,
  count(*) / CAST((SELECT count(*) FROM v_intent_v) AS DOUBLE) AS coverage, count(*) FILTER (p.best_intent = m.intent) / CAST(count(*) AS DOUBLE) AS precision
FROM (SELECT unnest(range(1001)) AS t) JOIN v_intent_v p ON floor(round(p.confidence * 1000, 9)) >= t JOIN val_messages_v m ON m.qid = p.qid GROUP BY t)""",
)
sv.define("chosen_v", f"SELECT min(threshold) AS threshold FROM thresholds_v WHERE lower_bound >= {VIEW_TARGET}")


def validated(spark, sf):
    """Predictions for the validation messages, with their labels."""
    messages, model, scored = _scored(spark, sf, "val")
    return classify.with_intent(scored, model.classes, 0.0).join(messages.select("qid", F.col("intent").alias("true_intent")), "qid")


@query(
    "chosen_threshold",
    sql(
        """SELECT c.threshold, n_kept, n_correct, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(lower_bound, 6) AS lower_bound
FROM chosen_v c LEFT JOIN thresholds_v t ON t.threshold = c.threshold"""
    ),
)
def chosen_threshold(spark, sf):
    """The lowest threshold whose precision on the validation split is proven to meet the target."""
    found = classify.chosen_threshold(validated(spark, sf), VIEW_TARGET)
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "lower_bound")})
