"""Prefix sums, ranks and quantiles that never put a whole table in one task.

Prefix sums: distinct values are dealt to ranges of their order once; what each
range adds up to is a table of one row per range and group, and its running
totals move the sums inside the ranges. Parallelism is that of the shuffle.

Quantiles: radix selection on the order-preserving 64-bit form of the values.
Each pass counts 16 bits more, only of values that share the bits so far with a
wanted rank, so the shuffles carry counters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from flowloom.tables import stored

#: Chunks that one window takes when something is carried over chunks.
CHUNKS_PER_BLOCK = 4096
#: Bits that a pass of the radix selection counts.
DIGIT = 16


def _summed_in_ranges(counted: DataFrame, by: list[str], counts: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``by``: number of the range, and sums of the rows before in it."""
    order = [F.col(c).asc_nulls_first() for c in by]
    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [f"{c}_before" for c in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), [0] * len(counts)
        for batch in batches:
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part))]
            for i, name in enumerate(counts):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(values) + sums[i]
                columns.append(pa.array(upto - values))
                sums[i] = int(upto[-1]) if len(upto) else sums[i]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", *names])

    schema = StructType([*counted.schema.fields, *[StructField(c, LongType()) for c in ("_part", *names)]])
    return dealt.mapInArrow(run, schema)


def running_totals(counted: DataFrame, group: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """Add ``<count>_before``, ``<count>_upto`` (sums over smaller, or equal, values)
    and ``<count>_all`` (sum of the group).

    ``counted`` holds each value once per group, and counts without NULLs.
    """
    key = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    # Ranges are cut at sampled values, so they are stored before they are read twice.
    placed = stored(_summed_in_ranges(counted, [*group, value], counts), "ranges").withColumn("_key", key)
    parts = placed.groupBy("_key", "_part").agg(
        *[F.min(f"{c}_before").alias(f"{c}_first") for c in counts], *[F.sum(c).alias(f"{c}_in") for c in counts]
    )
    # One row per range and group: a group has at most as many as there are ranges.
    whole = Window.partitionBy("_key")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        parts.select(
            "_key",
            "_part",
            *[
                (F.coalesce(F.sum(f"{c}_in").over(earlier), F.lit(0)) - F.col(f"{c}_first")).alias(f"{c}_base")
                for c in counts
            ],
            *[F.sum(f"{c}_in").over(whole).alias(f"{c}_all") for c in counts],
        ),
        "range_totals",
    )
    before = {f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_base") for c in counts}
    upto = {f"{c}_upto": F.col(f"{c}_before") + F.col(c) for c in counts}
    keep = [*counted.columns, *before, *upto, *[f"{c}_all" for c in counts]]
    return placed.join(bases, ["_key", "_part"]).withColumns(before).withColumns(upto).select(*keep)


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, value)`` rows of the non-NULL values of ``columns``."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    rows = df.select(*by, F.explode(pairs).alias("pair")).select(*by, "pair.feature", "pair.value")
    return rows.filter(F.col("value").isNotNull())


def _turned(bits: np.ndarray) -> np.ndarray:
    """Between the bits of doubles and integers of the same order; its own inverse."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


@F.pandas_udf(LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    # Adding zero makes the two zeros one.
    return pd.Series(_turned((values.to_numpy(np.float64) + 0.0).view(np.int64)))


@F.pandas_udf(DoubleType())
def _value_of(bits: pd.Series) -> pd.Series:
    return pd.Series(_turned(bits.to_numpy(np.int64)).view(np.float64))


def _select_ranks(rows: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """The bits at each rank, one row ``(_key, name, bits, n)`` per key and rank.

    ``rows`` are ``(_key, bits)``; ranks are of the sorted rows of a key, by their number n.
    """
    wanted = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        dealt = rows.withColumn("digits", F.shiftright("bits", shift))
        if wanted is None:
            dealt = dealt.withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            # A few rows per key; Spark broadcasts them where their stored size allows it.
            dealt = dealt.withColumn("prefix", F.shiftright("bits", shift + DIGIT))
            dealt = dealt.join(wanted.select("_key", "prefix").distinct(), ["_key", "prefix"])
        counted = dealt.groupBy("_key", "prefix", "digits").agg(F.count(F.lit(1)).alias("cell"))
        if wanted is None:
            counted = stored(counted, "digits")
            total = counted.groupBy("_key").agg(F.sum("cell").alias("n"))
            pairs = F.array(*[F.struct(F.lit(k).alias("name"), at.cast("bigint").alias("at")) for k, at in ranks.items()])
            first = total.select("_key", "n", F.explode(pairs).alias("w")).select("_key", "n", "w.*")
            wanted = first.withColumn("prefix", F.lit(0).cast("bigint"))
        # At most 2^DIGIT rows per window.
        smaller = Window.partitionBy("_key", "prefix").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
        cells = counted.withColumn("below", F.coalesce(F.sum("cell").over(smaller), F.lit(0)))
        inside = (F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("cell"))
        hit = wanted.join(cells, ["_key", "prefix"]).filter(inside)
        wanted = stored(
            hit.select("_key", "n", "name", (F.col("at") - F.col("below")).alias("at"), F.col("digits").alias("prefix")),
            "ranks",
        )
    return wanted.select("_key", "name", F.col("prefix").alias("bits"), "n")


def exact_quantiles(
    values: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probs`` maps output names to probabilities; NULL values are left out.
    """
    key = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    rows = values.filter(F.col(value).isNotNull()).select(
        key.alias("_key"), _ordered_bits(F.col(value).cast("double")).alias("bits")
    )
    positions = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    ranks = {}
    for name, position in positions.items():
        ranks |= {f"{name}_lo": F.floor(position), f"{name}_hi": F.ceil(position)}
    found = _select_ranks(stored(rows, "bits"), ranks).withColumn("value", _value_of("bits"))
    at = lambda rank: F.max(F.when(F.col("name") == rank, F.col("value")))
    wide = found.groupBy("_key").agg(F.max("n").alias("n"), *[at(r).alias(r) for r in ranks])
    results = []
    for name, position in positions.items():
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return wide.select(*(["_key.*"] if group else []), *results)


def approximate_quantiles(
    values: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One-pass quantile sketch for tables where exact ranks are not worth the shuffle."""
    array = F.percentile_approx(value, list(probs.values()), 100_000)
    return values.groupBy(*group).agg(array.alias("q")).select(
        *group, *[F.col("q")[i].alias(name) for i, name in enumerate(probs)]
    )


def before_chunks(
    chunks: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add to each row of ``(keys..., chunk)`` what the earlier chunks of its keys come to.

    ``columns`` maps a new name to ``("sum" | "max" | "last", column)``; "last" is
    the latest non-NULL value. Chunks are taken in blocks, so that no window holds
    more than one block's chunks, or all blocks.
    """
    keys = list(keys)
    blocked = chunks.withColumn("_block", F.floor(F.col("chunk") / F.lit(CHUNKS_PER_BLOCK)))
    inside = Window.partitionBy("_block", *keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def whole(kind: str, column: str) -> Column:
        if kind == "last":
            latest = F.struct(F.col("chunk"), F.col(column).alias("value"))
            return F.max(F.when(F.col(column).isNotNull(), latest))["value"]
        return {"sum": F.sum, "max": F.max}[kind](column)

    def running(kind: str, column: str, window) -> Column:
        if kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max}[kind](column).over(window)

    def both(kind: str, first: Column, second: Column) -> Column:
        if kind == "sum":
            return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))
        return F.greatest(first, second) if kind == "max" else F.coalesce(second, first)

    blocks = blocked.groupBy("_block", *keys).agg(
        *[whole(kind, c).alias(f"_{name}") for name, (kind, c) in columns.items()]
    )
    starts = blocks.select(
        "_block", *keys, *[running(kind, f"_{name}", across).alias(f"_{name}") for name, (kind, _) in columns.items()]
    )
    placed = blocked.join(starts, ["_block", *keys])
    added = {
        name: both(kind, F.col(f"_{name}"), running(kind, c, inside)) for name, (kind, c) in columns.items()
    }
    return placed.withColumns(added).drop("_block", *[f"_{name}" for name in columns])


def changes_in_order(df: DataFrame, order: str, value: str, span: int = 1 << 20) -> DataFrame:
    """One row: rows, value changes in the given order, whether it looks shuffled.

    The first row counts as a change. Each chunk of the (integer) order column
    is counted alone; the step from one chunk to the next is added from the
    chunk summaries.
    """
    chunked = df.select(
        F.floor(F.col(order) / F.lit(span)).alias("chunk"),
        F.col(order).alias("pos"),
        F.col(value).alias("val"),
    )
    w = Window.partitionBy("chunk").orderBy("pos")
    stepped = chunked.withColumn("prev", F.lag("val").over(w))
    per_chunk = stepped.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("val") != F.col("prev")).alias("inner_changes"),
        F.min_by("val", "pos").alias("first_val"),
        F.max_by("val", "pos").alias("last_val"),
    )
    # Stored, for summaries are read twice and the rows are to be read once.
    ended = stored(per_chunk.withColumn("ended", F.struct("last_val")), "chunks")
    carried = before_chunks(ended, [], {"before": ("last", "ended")})
    seam = F.col("first_val") != F.col("before.last_val")
    seamed = carried.withColumn("seam", F.coalesce(seam, F.lit(True)))
    counted = seamed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_total"),
        (
            F.coalesce(F.sum("inner_changes"), F.lit(0)) + F.count_if(F.col("seam"))
        ).alias("label_changes"),
    )
    # Fixed value: more than one change per hundred rows counts as shuffled.
    return counted.withColumn(
        "is_shuffled", F.col("label_changes") > F.col("row_total") * F.lit(0.01)
    )
