"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of this application."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts the lineage.

    ``by`` names a column whose values get folders of their own.
    """
    folder = scratch_folder(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
