"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.tables import scratch_folder, stored

__all__ = ["stored", "scratch_folder", "table", "remainder", "held_out", "whole_text", "numbered", "release_arrow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def held_out(key: str, folds: int) -> Column:
    """True for the fold that nothing is learned from; a null key is never learned from."""
    return F.coalesce(remainder(key, folds) == 0, F.lit(True))


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and the name of its column.

    The numbers are stored, as they would change where a scan is cut in another way.
    """
    name, taken = "__row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def release_arrow() -> None:
    """Gives memory of finished Arrow batches back to the system; workers live on between stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
