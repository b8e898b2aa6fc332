"""Flow tables from CSV files and extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.prepare import numeric_if_all_parse
from flowloom.schemas import FLOW_DDL, LABELLED_FLOW_DDL


def read_flows(
    spark: SparkSession,
    path: str | Sequence[str],
    labelled: bool = False,
    limit: int | None = None,
    malformed: str = "PERMISSIVE",
) -> DataFrame:
    """Flow CSV with the fixed schema; ``limit`` reads a prefix for a preview.

    ``malformed="DROPMALFORMED"`` skips lines that do not fit.
    """
    flows = (
        spark.read.schema(LABELLED_FLOW_DDL if labelled else FLOW_DDL)
        .option("header", True)
        .option("mode", malformed)
        .csv(list(path) if not isinstance(path, str) else path)
    )
    return flows if limit is None else flows.limit(limit)


def read_untyped(spark: SparkSession, path: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """CSV without a known schema: a column is numeric only if all its values are."""
    table = spark.read.option("header", True).csv(list(path) if not isinstance(path, str) else path)
    table = table if limit is None else table.limit(limit)
    return numeric_if_all_parse(table)


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split paths into those that exist and those that do not (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        (found if target.getFileSystem(conf).exists(target) else missing).append(path)
    return found, missing


def read_present(
    spark: SparkSession, paths: Sequence[str], labelled: bool = False
) -> tuple[DataFrame, list[str]]:
    """All files that exist, with their name in ``source``, and the missing names."""
    found, missing = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of the {len(paths)} flow files exists")
    flows = read_flows(spark, found, labelled)
    return flows.withColumn("source", F.col("_metadata.file_name")), missing


def rows_per_file(flows: DataFrame, source: str = "source") -> DataFrame:
    return flows.groupBy(source).agg(F.count(F.lit(1)).alias("row_total"))
