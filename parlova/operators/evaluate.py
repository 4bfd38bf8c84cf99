"""Classification, escalation and reply metrics, grouped by system.

Prediction tables have (system, example_id, gold_intent, pred_intent,
gold_escalate, pred_decision). All metrics come from counts per label pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlova.functions.text import token_count, vector_tokens
from parlova.operators.ranking import top_k
from parlova.schemas import AUTO_HANDLE, ESCALATE, OTHER_INTENT

# The generic reply.
GENERIC_REPLY = (
    "Thanks for reaching out. We're sorry you're having trouble. Please share "
    "more details so our support team can help."
)


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def label_pair_counts(pred: DataFrame, true_col: str, pred_col: str, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, true_col: str, pred_col: str, by: list[str] = []) -> DataFrame:
    """Counts for every pair of labels seen on either side, zeros kept."""
    pairs = label_pair_counts(pred, true_col, pred_col, by)
    labels = pairs.groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set("t"), F.collect_set("p"))).alias("labels")
    )
    grid = labels.select(*by, F.explode("labels").alias("t"), "labels").select(
        *by, "t", F.explode("labels").alias("p")
    )
    return (
        grid.join(pairs, [*by, "t", "p"], "left")
        .na.fill(0, ["n"])
        .select(*by, F.col("t").alias("true_label"), F.col("p").alias("pred_label"), "n")
    )


def per_label_metrics(pred: DataFrame, true_col: str, pred_col: str, by: list[str] = []) -> DataFrame:
    """Precision, recall, F1, support per label; 0 where a ratio is undefined."""
    return _label_metrics(label_pair_counts(pred, true_col, pred_col, by), by)


def _label_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    sides = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
            )
        ),
    )
    sums = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    return sums.select(
        *by,
        "label",
        _ratio("tp", "predicted").alias("precision"),
        _ratio("tp", "support").alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )


def classification_metrics(pred: DataFrame, true_col: str, pred_col: str, by: list[str] = []) -> DataFrame:
    """Accuracy, macro and weighted F1 over the union of true and predicted labels."""
    return _overall(per_label_metrics(pred, true_col, pred_col, by), by)


def _overall(labels: DataFrame, by: list[str]) -> DataFrame:
    return (
        labels.groupBy(*by)
        .agg(
            F.sum("support").alias("n_examples"),
            F.count(F.lit(1)).alias("n_labels"),
            _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        )
    )


# The chance that a Poisson(1) number is at most 0, 1, ... 8.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(9)]


def poisson_weight(id_col: Column, replicate: Column) -> Column:
    """How often a row counts in a replicate: a Poisson(1) number from a hash of both, the same on any cluster."""
    digest = F.md5(F.concat_ws("#", id_col.cast("string"), replicate.cast("string")))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return sum(F.when(share >= step, 1).otherwise(0) for step in POISSON_STEPS)


def metric_intervals(
    pred: DataFrame, id_col: str, true_col: str, pred_col: str, by: list[str], replicates: int = 200, level: float = 0.95
) -> DataFrame:
    """``by, metric, value, low, high``: accuracy, macro and weighted F1 with bootstrap limits.

    Every replicate counts each row as often as a Poisson number drawn from its id says, so all replicates come
    from one pass, whatever the partitioning; what is shuffled are label pairs per replicate, not rows. Limits
    are the outer quantiles of the replicates, interpolated. Rows of one id are drawn together.
    """
    drawn = (
        pred.select(*by, F.col(id_col).alias("_id"), F.col(true_col).alias("t"), F.col(pred_col).alias("p"))
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("_weight", poisson_weight(F.col("_id"), F.col("replicate")))
        .where("_weight > 0")
        .groupBy(*by, "replicate", "t", "p")
        .agg(F.sum("_weight").alias("n"))
    )
    keys = [*by, "replicate"]
    metrics = ["accuracy", "macro_f1", "weighted_f1"]
    sampled = _overall(_label_metrics(drawn, keys), keys)
    tail = (1 - level) / 2
    limits = sampled.groupBy(*by).agg(
        *[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in metrics]
    )
    points = classification_metrics(pred, true_col, pred_col, by).select(*by, *[F.col(m).alias(f"_{m}") for m in metrics])
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("value"), F.get(m, F.lit(0)).alias("low"), F.get(m, F.lit(1)).alias("high"))
            for m in metrics
        ]
    )
    return points.join(limits, by).select(*by, F.inline(rows))


def escalation_metrics(pred: DataFrame, by: list[str] = []) -> DataFrame:
    """Escalation as a binary decision; rates over all rows, null without rows."""
    g, p = F.col("gold_escalate"), F.col("pred_decision")
    counts = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(g == p).alias("_same"),
        F.count_if((g == ESCALATE) & (p == ESCALATE)).alias("_ee"),
        F.count_if(g == ESCALATE).alias("_gold_e"),
        F.count_if(p == ESCALATE).alias("_pred_e"),
        F.count_if((g == AUTO_HANDLE) & (p == AUTO_HANDLE)).alias("_aa"),
        F.count_if((g == ESCALATE) & (p == AUTO_HANDLE)).alias("unsafe_auto_handling_count"),
    )
    n, auto = F.col("n_examples"), F.col("n_examples") - F.col("_pred_e")
    return counts.select(
        *by,
        "n_examples",
        F.try_divide("_same", n).alias("accuracy"),
        _ratio("_ee", "_pred_e").alias("precision_escalate"),
        _ratio("_ee", "_gold_e").alias("recall_escalate"),
        _ratio(2 * F.col("_ee"), F.col("_gold_e") + F.col("_pred_e")).alias("f1_escalate"),
        F.try_divide("_aa", auto).alias("auto_handle_accuracy"),
        "unsafe_auto_handling_count",
        F.try_divide("unsafe_auto_handling_count", n).alias("unsafe_auto_handling_rate"),
        F.try_divide("_pred_e", n).alias("escalation_rate"),
        F.try_divide(auto, n).alias("automation_rate"),
    )


def escalation_matrix(pred: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts of the four pairs of gold and predicted decision; both labels always appear."""
    cells = [(g, p) for g in (ESCALATE, AUTO_HANDLE) for p in (ESCALATE, AUTO_HANDLE)]
    counts = pred.groupBy(*by).agg(
        *[
            F.count_if((F.col("gold_escalate") == g) & (F.col("pred_decision") == p)).alias(f"_{i}")
            for i, (g, p) in enumerate(cells)
        ]
    )
    rows = [
        F.struct(F.lit(g).alias("gold_escalate"), F.lit(p).alias("pred_decision"), F.col(f"_{i}").alias("n"))
        for i, (g, p) in enumerate(cells)
    ]
    return counts.select(*by, F.inline(F.array(*rows)))


PENDING = "PENDING_GOLDEN_SET_ANNOTATION"


def evaluation_status(golden: DataFrame | None) -> DataFrame:
    """One row (status, n_rows, n_annotated): pending without a row that has both labels."""
    if golden is None:
        spark = SparkSession.active()
        return spark.range(1).select(F.lit(PENDING).alias("status"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_annotated"))
    done = F.count_if(F.col("gold_intent").isNotNull() & F.col("gold_escalate").isNotNull())
    return golden.agg(
        F.when(done > 0, "EVALUATED").otherwise(PENDING).alias("status"), F.count(F.lit(1)).alias("n_rows"), done.alias("n_annotated")
    )


def baseline_a(golden: DataFrame, majority: DataFrame, label_col: str = "intent") -> DataFrame:
    """Majority intent, generic reply, always escalated."""
    label = F.coalesce(majority.select(label_col).scalar(), F.lit(OTHER_INTENT))
    return golden.withColumns(
        {"pred_intent": label, "draft_reply": F.lit(GENERIC_REPLY), "pred_decision": F.lit(ESCALATE)}
    )


def baseline_b(golden: DataFrame, predictions: DataFrame, nearest: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Ungated best intent, nearest historical reply, escalated below the threshold.

    ``predictions`` (qid, intent, confidence) and ``nearest`` (qid, support_reply)
    refer to golden rows by ``qid``.
    """
    return (
        golden.join(predictions.select("qid", F.col("intent").alias("pred_intent"), "confidence"), "qid")
        .join(nearest.select("qid", "support_reply"), "qid", "left")
        .withColumn("draft_reply", F.coalesce("support_reply", F.lit(GENERIC_REPLY)))
        .withColumn("pred_decision", F.when(F.col("confidence") >= threshold, AUTO_HANDLE).otherwise(ESCALATE))
        .drop("support_reply", "confidence")
    )


# --- reply similarity -------------------------------------------------------


def reply_similarity(pairs: DataFrame, id_col: str, reply: str, reference: str) -> DataFrame:
    """TF-IDF cosine of two texts, fitted on these two only.

    With two texts the smoothed idf is 1 for a shared token and ln(1.5) + 1 for
    one that only one side has. An empty side, or no usable token, gives 0. Texts are
    dealt by id once; their tokens are counted where they then lie.
    """
    sides = pairs.select(id_col, reply, reference).repartition(id_col).select(
        id_col,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), vector_tokens(F.col(reply)).alias("tokens")),
                F.struct(F.lit(1).alias("side"), vector_tokens(F.col(reference)).alias("tokens")),
            )
        ),
    )
    tf = (
        sides.select(id_col, "side", F.explode("tokens").alias("token"))
        .groupBy(id_col, "token")
        .agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    )
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1.0)
    x, y = F.col("a") * idf, F.col("b") * idf
    sums = tf.groupBy(id_col).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    cos = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return pairs.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce(cos, F.lit(0.0)).alias("similarity"))


# --- failures ---------------------------------------------------------------


def failure_category() -> Column:
    """Category of an evaluation row, null when it is right. Null never equals null."""
    no = F.lit(False)
    intent_ok = F.coalesce(F.col("gold_intent") == F.col("pred_intent"), no)
    decision_ok = F.coalesce(F.col("gold_escalate") == F.col("pred_decision"), no)
    novel = F.coalesce(F.col("gold_intent") == OTHER_INTENT, no) & ~F.coalesce(F.col("pred_intent") == OTHER_INTENT, no)
    unsafe = (F.col("gold_escalate") == ESCALATE) & (F.col("pred_decision") == AUTO_HANDLE)
    return (
        F.when(intent_ok & decision_ok, F.lit(None).cast("string"))
        .when(token_count(F.coalesce("customer_text", F.lit(""))) <= 4, "VERY_SHORT_MESSAGE")
        .when(novel, "NOVEL_OR_AMBIGUOUS_INTENT")
        .when(unsafe, "UNSAFE_AUTO_HANDLING")
        .when(~intent_ok, "INTENT_MISCLASSIFICATION")
        .otherwise("ESCALATION_THRESHOLD_ERROR")
    )


def failure_modes(eval_rows: DataFrame, top_n: int = 5) -> DataFrame:
    """The most frequent categories, with an explicit rank (ties by name)."""
    counts = (
        eval_rows.withColumn("failure_category", failure_category())
        .where(F.col("failure_category").isNotNull())
        .groupBy("failure_category")
        .agg(F.count(F.lit(1)).alias("n_examples"))
    )
    # At most six categories exist, so this window is over a handful of rows.
    order = Window.orderBy(F.col("n_examples").desc(), "failure_category")
    return counts.withColumn("mode_rank", F.row_number().over(order).cast("bigint")).where(F.col("mode_rank") <= top_n)


def failure_examples(eval_rows: DataFrame, top_n: int = 5, per_mode: int = 3) -> DataFrame:
    """The first ``per_mode`` real rows of each frequent category."""
    modes = failure_modes(eval_rows, top_n)
    failed = eval_rows.withColumn("failure_category", failure_category()).where(F.col("failure_category").isNotNull())
    first = top_k(failed, ["failure_category"], [F.col("example_id")], per_mode, "example_rank")
    return first.join(F.broadcast(modes), "failure_category").select(
        "failure_category",
        "n_examples",
        "example_rank",
        F.col("customer_text").alias("example_customer_text"),
        "pred_intent",
        "gold_intent",
        "pred_decision",
        "gold_escalate",
        "retrieved_top_example",
    )


# --- comparison table -------------------------------------------------------


def shown(value: Column, percent: bool = False) -> Column:
    """A number as report text; null as PENDING."""
    text = F.format_string("%.1f%%", value * 100.0) if percent else F.format_string("%.3f", value)
    return F.when(value.isNull(), "PENDING").otherwise(text)


def comparison_table(systems: DataFrame, classification: DataFrame, escalation: DataFrame, judged: DataFrame) -> DataFrame:
    """One text row per system; whatever has not been measured reads PENDING.

    ``systems`` (system), ``judged`` (system, mean_groundedness, mean_helpfulness).
    """
    return (
        systems.select("system")
        .join(classification.select("system", "macro_f1", F.col("accuracy").alias("intent_accuracy")), "system", "left")
        .join(escalation.select("system", "unsafe_auto_handling_rate", "automation_rate"), "system", "left")
        .join(judged.select("system", "mean_groundedness", "mean_helpfulness"), "system", "left")
        .select(
            "system",
            shown(F.col("macro_f1")).alias("intent_macro_f1"),
            shown(F.col("intent_accuracy"), True).alias("intent_accuracy"),
            shown(F.col("mean_groundedness")).alias("reply_grounding"),
            shown(F.col("mean_helpfulness")).alias("reply_helpfulness"),
            shown(F.col("unsafe_auto_handling_rate"), True).alias("unsafe_auto_handling"),
            shown(F.col("automation_rate"), True).alias("automation_rate"),
        )
    )
