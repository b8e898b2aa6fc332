"""Sinks for flow tables, predictions and baselines."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import fixed4
from flowloom.schemas import FLOW_FIELDS

log = logging.getLogger(__name__)

# Double columns the export prints without rounding.
RAW_DOUBLES = ["total_fwd_bytes", "total_bwd_bytes"]


def export_columns(labelled: bool) -> list[Column]:
    """The flow columns as the text of the export: four decimals, plain integers."""
    columns = []
    for name, kind in FLOW_FIELDS:
        if kind == "double" and name not in RAW_DOUBLES:
            columns.append(fixed4(F.col(name)).alias(name))
        else:
            columns.append(F.col(name).cast("string").alias(name))
    return columns + ([F.col("label")] if labelled else [])


def export_lines(flows: DataFrame, labelled: bool) -> DataFrame:
    """One comma-separated ``line`` per flow."""
    return flows.select(F.concat_ws(",", *export_columns(labelled)).alias("line"))


def write_flow_csv(flows: DataFrame, path: str, labelled: bool = False, mode: str = "overwrite") -> None:
    """Flow CSV with a header in every part file; ``mode="append"`` adds part files."""
    flows.select(*export_columns(labelled)).write.mode(mode).option("header", True).csv(path)


def write_flows(flows: DataFrame, path: str, by: str = "capture_id", mode: str = "append") -> None:
    """Columnar flow table, one folder per capture, for reading with partition pruning."""
    flows.write.mode(mode).partitionBy(by).parquet(path)


def write_pair(flows: DataFrame, labelled_path: str, plain_path: str, label: str = "label") -> None:
    """The same rows with and without the label."""
    flows.write.mode("overwrite").option("header", True).csv(labelled_path)
    flows.drop(label).write.mode("overwrite").option("header", True).csv(plain_path)


#: Gets the rows and the number of the batch; returns the rows as written, read back.
Sink = Callable[[DataFrame, int], DataFrame]


def folder_sink(path: str, kind: str = "parquet") -> Sink:
    """One folder per batch, so that a batch that is replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> DataFrame:
        target = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").format(kind).save(target)
        return batch.sparkSession.read.schema(batch.schema).format(kind).load(target)

    return write


def tee(write_main: Sink, write_extra: Callable[[DataFrame, int], object]):
    """A batch function for two sinks; a failing second sink is logged, not raised.

    Usable with ``foreachBatch`` and on a plain table. The second sink reads what
    the main one wrote, so the rows are computed once and not held on executors.
    """

    def write(batch: DataFrame, batch_id: int = 0) -> None:
        written = write_main(batch, batch_id)
        try:
            write_extra(written, batch_id)
        except Exception as error:  # noqa: BLE001 - the second sink is best effort
            log.warning("second sink failed for batch %s: %s", batch_id, error)

    return write


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def write_predictions(
    predictions: DataFrame, path: str, stamp: str | None = None, kind: str = "csv"
) -> str:
    """Write below ``<path>/run=<stamp>`` and return that folder."""
    target = f"{path}/run={stamp or run_stamp()}"
    writer = predictions.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(target)
    else:
        writer.parquet(target)
    return target


def write_baseline(statistics: DataFrame, path: str) -> None:
    """Baseline statistics: 36 features at most, so one file."""
    statistics.coalesce(1).write.mode("overwrite").parquet(path)
