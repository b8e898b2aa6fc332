"""Row numbers and running sums over a whole table from per-partition totals.

Rows are dealt to ranges of their order and sorted there once. What each range
holds of each group is added up in a table of one row per range and group; the
running totals of that table, added to the places inside the ranges, number the
rows of the whole table. No task holds a group, and rows move once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowloom.llm.common import stored

_TIE, _PART, _PLACE, _FIRST = "__tie", "__part", "__place", "__first"


def numbered(
    rows: DataFrame, order: Sequence[str], group: str | None = None, sums: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Adds ``place`` (from 0 in its group), ``n`` (rows of the group), ``<sum>_before`` and ``<sum>_all``.

    ``group`` holds no nulls; nulls of ``order`` come first, rows that are equal
    there follow each other in any order. Sums are of bigint columns without nulls.
    Second, the totals: a row (group, n, sums) per group. Both are of stored tables,
    since ranges are cut at sampled values. Other columns must not have these names.
    """
    names = ([group] if group else []) + list(order)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are dealt to several ranges by where they come from.
    tied = rows.withColumn(_TIE, F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*names, _TIE]]
    dealt = tied.repartitionByRange(width, *by).sortWithinPartitions(*by).drop(_TIE)
    placed = stored(_in_ranges(dealt, sums), "ranges")
    keys = [_PART, *([group] if group else [])]
    parts = placed.groupBy(*keys).agg(
        F.min(_PLACE).alias(_FIRST),
        F.count(F.lit(1)).alias("n"),
        *[F.min(f"{s}_before").alias(f"{s}_first") for s in sums],
        *[F.sum(s).alias(f"{s}_in") for s in sums],
    )
    # One row per range and group: a group has at most as many as there are ranges.
    every = Window.partitionBy(*([group] if group else [F.lit(0)]))
    before = every.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = stored(
        parts.select(
            *keys,
            (sofar("n") - F.col(_FIRST)).alias("n_base"),
            F.sum("n").over(every).alias("n"),
            *[(sofar(f"{s}_in") - F.col(f"{s}_first")).alias(f"{s}_base") for s in sums],
            *[F.sum(f"{s}_in").over(every).alias(f"{s}_all") for s in sums],
        ),
        "range_totals",
    )
    totals = bases.select(*([group] if group else []), "n", *[f"{s}_all" for s in sums]).distinct()
    joined = placed.join(bases if group else F.broadcast(bases), keys)
    out = joined.select(
        *rows.columns,
        (F.col(_PLACE) + F.col("n_base")).alias("place"),
        "n",
        *[f"{s}_all" for s in sums],
        *[(F.col(f"{s}_before") + F.col(f"{s}_base")).alias(f"{s}_before") for s in sums],
    )
    return out, totals


def _in_ranges(dealt: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Number of the partition, place in it and running sums of the rows before in it."""
    added = [_PART, _PLACE, *[f"{s}_before" for s in sums]]
    if not sums:
        number = F.monotonically_increasing_id()
        ids = dealt.withColumn("__id", number)
        return ids.select(
            *dealt.columns,
            F.shiftright("__id", 33).alias(_PART),
            F.col("__id").bitwiseAND((1 << 33) - 1).alias(_PLACE),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, so_far = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(place, place + n))]
            for i, name in enumerate(sums):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(values) + so_far[i]
                columns.append(pa.array(upto - values))
                so_far[i] = int(upto[-1]) if n else so_far[i]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    schema = StructType([*dealt.schema.fields, *[StructField(c, LongType()) for c in added]])
    return dealt.mapInArrow(run, schema)
