"""Prediction tables and detection reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import label_text, risk_level
from flowloom.operators.profile import time_range
from flowloom.schemas import HIDDEN_IN_REPORTS


def threshold_prediction(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def prediction_table(
    scored: DataFrame, score: str = "score", actual: str | None = None, threshold: float = 0.5, keep=()
) -> DataFrame:
    """Prediction, its text, both confidences and their maximum; plus truth if given."""
    attack = F.col(score).cast("double")
    prediction = threshold_prediction(attack, threshold)
    columns = [
        prediction.alias("prediction"),
        label_text(prediction).alias("prediction_label"),
        (1 - attack).alias("confidence_benign"),
        attack.alias("confidence_attack"),
        F.greatest(attack, 1 - attack).alias("confidence"),
    ]
    if actual is not None:
        truth = F.col(actual)
        columns += [
            truth.alias("actual"),
            label_text(truth).alias("actual_label"),
            (truth == prediction).alias("correct"),
        ]
    return scored.select(*keep, *columns)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def detection_report(
    scored: DataFrame,
    score: str = "score",
    prediction: str | None = None,
    risk_on: str = "max",
    time_text: str | None = None,
) -> DataFrame:
    """All input columns, the time range, prediction, confidences and risk level.

    The risk level follows the higher of the two confidences, so a certain
    benign flow is CRITICAL as well; ``risk_on="attack"`` rates the attack
    probability instead. ``time_text`` replaces the time range (needed on
    streams, which have no overall range).
    """
    if risk_on not in ("max", "attack"):
        raise ValueError("risk_on must be 'max' or 'attack'")
    attack = F.col(score).cast("double")
    predicted = F.col(prediction).cast("int") if prediction else threshold_prediction(attack)
    span = F.lit(time_text) if time_text is not None else time_range(scored).scalar()
    confidence = F.greatest(attack, 1 - attack)
    used = {score, prediction, *HIDDEN_IN_REPORTS}
    kept = [c for c in scored.columns if c not in used]
    return scored.select(
        *kept,
        span.alias("timestamp_range"),
        predicted.alias("prediction"),
        label_text(predicted).alias("prediction_label"),
        (1 - attack).alias("confidence_benign"),
        attack.alias("confidence_attack"),
        confidence.alias("confidence_score"),
        risk_level(confidence if risk_on == "max" else attack).alias("risk_level"),
    )
