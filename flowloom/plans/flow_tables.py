"""The three ways through the library: capture to flows, flows to model, flows to report.

A flow table is built once and read many times. :func:`stored` writes a table to
the shared folder of the cluster and reads it back, so later plans start from
columnar files instead of sessionizing the packets again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowloom.operators.evaluate import evaluate_sets
from flowloom.operators.flow_features import flow_features
from flowloom.operators.learn import fit, score
from flowloom.operators.prepare import build_dataset
from flowloom.operators.report import detection_report
from flowloom.operators.sampling import stratified_split
from flowloom.sources import capture
from flowloom.sources.decode import decode_frames
from flowloom.tables import scratch_folder, stored  # noqa: F401


#: Names a flow built from captures (``first_seq`` is unique in its capture only).
FLOW_ID = ("capture_id", "first_seq")
_HANDLE = (*FLOW_ID, "flow_no", "start_ms", "end_ms")


def flows_from_captures(
    spark: SparkSession, path: str, label: str | None = None, split_bytes: int | None = None
) -> DataFrame:
    """Capture files to the labelled or unlabelled flow table.

    The columns of ``FLOW_ID`` and the times come along, so that the table can be
    audited, sampled and split.
    """
    capture.register(spark)
    reader = spark.read.format("capture")
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    return flow_features(decode_frames(reader.load(path)), label=label, keep=_HANDLE)


def trained_model(
    attacks: DataFrame,
    benign: DataFrame,
    key: Sequence[str],
    kind: str = "boosted_deep",
    test_fraction: float = 0.2,
    quotas: dict[str, int] | None = None,
    **settings,
) -> tuple[PipelineModel, DataFrame]:
    """Balance, label, split and fit; returns the model and its test metrics.

    The split data set is stored: training reads it many times.
    """
    dataset = build_dataset(attacks, benign, key, quotas=quotas, shuffled=False)
    split = stored(stratified_split(dataset, test_fraction, key), "dataset")
    model = fit(split.filter("split = 'train'"), kind, **settings)
    scored = score(model, split.filter("split = 'test'"))
    return model, evaluate_sets(scored.withColumnRenamed("split", "test_name"))


def detect(model: PipelineModel, flows: DataFrame, risk_on: str = "max") -> DataFrame:
    """Flow table to detection report."""
    scored = score(model, flows).withColumnRenamed("prediction", "model_class")
    return detection_report(scored, prediction="model_class", risk_on=risk_on)
