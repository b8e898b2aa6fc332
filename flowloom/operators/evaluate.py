"""Classifier evaluation from counts: every metric comes from grouped sums.

Input tables hold ``label`` (0/1), ``prediction`` (0/1) and, for curves,
``score`` (probability of class 1). ``by`` evaluates several test sets at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import label_text, ratio_or_zero
from flowloom.operators.ordered import running_totals


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp``, one row per test set."""
    label, prediction = F.col("label"), F.col("prediction")
    return df.groupBy(*by).agg(
        F.count_if((label == 0) & (prediction == 0)).alias("tn"),
        F.count_if((label == 0) & (prediction == 1)).alias("fp"),
        F.count_if((label == 1) & (prediction == 0)).alias("fn"),
        F.count_if((label == 1) & (prediction == 1)).alias("tp"),
    )


def confusion_percent(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The confusion matrix in percent of each actual class."""
    counts = confusion(df, by)
    benign, attack = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return counts.withColumns(
        {
            "tn_percent": ratio_or_zero(F.col("tn") * 100, benign),
            "fp_percent": ratio_or_zero(F.col("fp") * 100, benign),
            "fn_percent": ratio_or_zero(F.col("fn") * 100, attack),
            "tp_percent": ratio_or_zero(F.col("tp") * 100, attack),
        }
    )


def _f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, precision * 2 * recall / total).otherwise(F.lit(0.0))


def scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity, FPR and FNR; 0 for empty divisors."""
    return scores_from_counts(confusion(df, by))


def scores_from_counts(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return counts.withColumns(
        {
            "accuracy": ratio_or_zero(tp + tn, tn + fp + fn + tp),
            "precision": precision,
            "recall": recall,
            "f1": _f1(precision, recall),
            "specificity": ratio_or_zero(tn, tn + fp),
            "false_positive_rate": ratio_or_zero(fp, fp + tn),
            "false_negative_rate": ratio_or_zero(fn, fn + tp),
        }
    )


def class_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    counts = confusion(df, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(position: int, name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("class_name"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def parts(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column, Column]:
        precision, recall = ratio_or_zero(hit, hit + wrong), ratio_or_zero(hit, hit + missed)
        return precision, recall, _f1(precision, recall), hit + missed

    benign, attack = parts(tn, fn, fp), parts(tp, fp, fn)
    total = benign[3] + attack[3]
    macro = [(b + a) / 2 for b, a in zip(benign[:3], attack[:3])]
    weighted = [
        ratio_or_zero(b * benign[3] + a * attack[3], total) for b, a in zip(benign[:3], attack[:3])
    ]
    lines = F.array(
        line(0, "BENIGN", *benign),
        line(1, "ATTACK", *attack),
        line(2, "macro avg", *macro, total),
        line(3, "weighted avg", *weighted, total),
    )
    return counts.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


def score_steps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: rows of each class there and above it.

    Equal scores collapse before any ordering, and the running totals are
    bucketed, so no window spans the table.
    """
    label = F.col("label")
    counted = df.groupBy(*by, (-F.col("score").cast("double")).alias("down")).agg(
        F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg")
    )
    steps = running_totals(counted, by, "down", ["pos", "neg"])
    return steps.withColumn("threshold", -F.col("down")).drop("down")


def roc_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All points of the ROC curve, one per distinct score (the origin is implied)."""
    steps = score_steps(df, by)
    return steps.select(
        *by,
        "threshold",
        ratio_or_zero(F.col("neg_upto"), F.col("neg_all")).alias("fpr"),
        ratio_or_zero(F.col("pos_upto"), F.col("pos_all")).alias("tpr"),
    )


def precision_recall_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All points of the precision-recall curve (the end point (0, 1) is implied)."""
    steps = score_steps(df, by)
    tp, fp = F.col("pos_upto"), F.col("neg_upto")
    return steps.select(
        *by,
        "threshold",
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, F.col("pos_all")).alias("recall"),
    )


def curve_areas(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC and precision-recall areas by trapezoids.

    The ROC area is NULL unless both classes occur; the precision-recall area
    is NULL without positives. Each trapezoid needs its own step only.
    """
    steps = score_steps(df, by)
    tp, fp = F.col("pos_upto").cast("double"), F.col("neg_upto").cast("double")
    tp0, fp0 = F.col("pos_before").cast("double"), F.col("neg_before").cast("double")
    precision = ratio_or_zero(tp, tp + fp)
    precision0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    sums = steps.groupBy(*by).agg(
        F.sum(F.col("neg") * (tp0 + tp)).alias("roc_twice"),
        F.sum(F.col("pos") * (precision0 + precision)).alias("pr_twice"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(
        *by,
        F.when((pos > 0) & (neg > 0), F.col("roc_twice") / (pos * neg * 2)).alias("roc_auc"),
        F.when(pos > 0, F.col("pr_twice") / (pos * 2)).alias("pr_auc"),
    )


def evaluate_sets(df: DataFrame, by: str = "test_name") -> DataFrame:
    """Metrics of several named test sets in one table, rows and areas included."""
    counts = scores(df, [by])
    sizes = (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("row_total")
    areas = curve_areas(df, [by])
    return counts.select("*", sizes).join(areas, by, "left")


def prediction_distribution(df: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = df.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "prediction",
        label_text(F.col("prediction")).alias("prediction_label"),
        "n",
        (F.col("n") * 100.0 / total).alias("percent"),
    )


# Share of rows expected in the named class, per scenario, in percent.
EXPECTED_SHARES = [
    ("normal traffic", 0, 70.0, 90.0),
    ("attack traffic", 1, 80.0, 95.0),
    ("query flood", 1, 90.0, 100.0),
    ("amplification", 1, 85.0, 100.0),
    ("mixed attack", 1, 95.0, 100.0),
]


def expected_share_check(df: DataFrame, scenario: str = "scenario", bands=EXPECTED_SHARES) -> DataFrame:
    """Is the share of the expected class inside its band, per scenario?

    Scenarios without a band have NULL in ``in_band``.
    """
    expected = low = high = F.lit(None)
    for name, label, least, most in bands:
        match = F.col(scenario) == name
        expected = F.when(match, label).otherwise(expected)
        low = F.when(match, F.lit(least)).otherwise(low)
        high = F.when(match, F.lit(most)).otherwise(high)
    counted = df.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("row_total"),
        F.count_if(F.col("prediction") == expected).alias("as_expected"),
    )
    counted = counted.withColumn("share", F.col("as_expected") * 100.0 / F.col("row_total"))
    return counted.withColumns(
        {
            "low": low.cast("double"),
            "high": high.cast("double"),
            "in_band": F.col("share").between(low.cast("double"), high.cast("double")),
        }
    )
