"""Exact, reproducible samples and splits without a single-task sort.

Rows are ordered by the md5 of their identity and a seed. The first five hex
digits of the hash give 2**20 buckets; bucket counts tell which bucket holds the
n-th row, and only that bucket is ranked row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.columns import sample_order
from flowloom.operators.ordered import before_chunks, changes_in_order, running_totals
from flowloom.tables import stored

_DIGITS = 5


def _with_order(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    order = sample_order(*[F.col(k) for k in key], seed=seed)
    return df.withColumn("_order", order).withColumn(
        "_bucket", F.conv(F.substring("_order", 1, _DIGITS), 16, 10).cast("int")
    )


def _cutoffs(ordered: DataFrame, group: Column, target: Column) -> DataFrame:
    """Per group: the bucket with the last wanted row, and how many rows of it to take."""
    sizes = ordered.groupBy(group.alias("_group"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_group")
    upto = F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumns({"_upto": upto, "_size": F.sum("_n").over(w)})
    sizes = sizes.withColumn("_target", target)
    reached = F.col("_upto") >= F.col("_target")
    return sizes.groupBy("_group").agg(
        F.min(F.when(reached, F.struct("_bucket", (F.col("_target") - F.col("_upto") + F.col("_n")).alias("_take")))).alias("_cut"),
        F.max("_bucket").alias("_last"),
    )


def _choose(ordered: DataFrame, group: Column, groups: int, target: Column) -> DataFrame:
    """``ordered`` plus ``_taken``; rows of no group are not taken.

    The cut-off table has one row per group and the number of groups is fixed
    by the caller, which bounds the broadcast.
    """
    cuts = F.broadcast(_cutoffs(ordered, group, target).limit(groups))
    placed = ordered.withColumn("_group", group).join(cuts, "_group", "left")
    edge = F.col("_cut").isNotNull() & (F.col("_bucket") == F.col("_cut._bucket"))
    clear = placed.filter(F.coalesce(~edge, F.lit(True))).withColumn(
        "_taken",
        F.coalesce(
            F.when(F.col("_cut").isNull(), F.col("_last").isNotNull()).otherwise(
                F.col("_bucket") < F.col("_cut._bucket")
            ),
            F.lit(False),
        ),
    )
    rank = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_order"))
    close = placed.filter(edge).withColumn("_taken", rank <= F.col("_cut._take"))
    return clear.unionByName(close)


def exact_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all rows if there are fewer), the first in hash order."""
    if n <= 0:
        return df.limit(0)
    chosen = _choose(_with_order(df, key, seed), F.lit(0), 1, F.lit(n))
    return chosen.filter("_taken").select(*df.columns)


def balance_classes(
    df: DataFrame, column: str, quotas: dict, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Cut the listed classes down to their quotas; other classes are kept whole."""
    index = F.lit(-1)
    target = F.lit(0)
    for i, (value, quota) in enumerate(quotas.items()):
        index = F.when(F.col(column) == value, i).otherwise(index)
        target = F.when(F.col("_group") == i, quota).otherwise(target)
    # A class to keep whole has a target above its size.
    target = F.when(F.col("_group") == -1, F.col("_size") + 1).otherwise(target)
    chosen = _choose(_with_order(df, key, seed), index, len(quotas) + 1, target)
    return chosen.filter("_taken").select(*df.columns)


def stratified_split(
    df: DataFrame,
    test_fraction: float,
    key: Sequence[str],
    label: str = "label",
    classes: Sequence = (0, 1),
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` ('train'/'test') with an exact share of every class.

    Rows of other classes (or without a label) form one stratum of their own.
    """
    index = F.lit(-1)
    for i, value in enumerate(classes):
        index = F.when(F.col(label) == value, i).otherwise(index)
    target = F.round(F.col("_size") * F.lit(test_fraction)).cast("bigint")
    chosen = _choose(_with_order(df, key, seed), index, len(classes) + 1, target)
    return chosen.select(*df.columns, F.when(F.col("_taken"), "test").otherwise("train").alias("split"))


def stratified_folds(
    df: DataFrame, folds: int, key: Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Add ``fold`` (0 .. folds - 1): rows of a class are dealt in hash order.

    A row's place is the number of rows in earlier buckets of its class plus its
    rank in the bucket, so a window holds one bucket's rows, or the bucket counts.
    """
    ordered = _with_order(df, key, seed).withColumn("_group", F.col(label))
    sizes = ordered.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    same = F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b"))
    rank = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_order")) - 1
    place = F.col("_start") + F.col("_rank")
    return (
        ordered.withColumn("_rank", rank)
        .join(starts, same)
        .select(*df.columns, F.pmod(place, F.lit(folds)).cast("int").alias("fold"))
    )


def hash_split(df: DataFrame, test_fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """One-pass split by hash; class shares are met on average, not exactly."""
    ordered = _with_order(df, key, seed)
    limit = int(round(test_fraction * 16**_DIGITS))
    split = F.when(F.col("_bucket") < limit, "test").otherwise("train")
    return ordered.select(*df.columns, split.alias("split"))


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in hash order (a range-partitioned distributed sort)."""
    order = sample_order(*[F.col(k) for k in key], seed=seed)
    return df.withColumn("_order", order).orderBy("_order").drop("_order")


def shuffle_if_sorted(
    df: DataFrame, order: str, label: str, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Shuffle only if the labels come in long runs; decided from one summary row."""
    state = changes_in_order(df, order, label).first()
    return df if state["is_shuffled"] else shuffle_rows(df, key, seed)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a given order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def pick_positions(df: DataFrame, order: str, span: int = 1 << 20) -> DataFrame:
    """First, middle and last row in order; the middle is n/2 rounded half to even.

    Ranks come from chunk counts, so only the three rows' chunks are ordered.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(span)))
    sizes = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    sizes = stored(sizes.withColumnRenamed("_chunk", "chunk"), "chunks")
    sizes = before_chunks(sizes, [], {"_before": ("sum", "_n")})
    sizes = sizes.withColumnRenamed("chunk", "_chunk")
    total = sizes.agg(F.sum("_n").alias("t")).scalar()
    wanted = F.array(
        F.struct(F.lit("top").alias("pick"), F.lit(0).cast("bigint").alias("at")),
        F.struct(F.lit("middle").alias("pick"), F.bround(F.col("_t") / 2).cast("bigint").alias("at")),
        F.struct(F.lit("bottom").alias("pick"), (F.col("_t") - 1).alias("at")),
    )
    hits = (
        sizes.withColumn("_t", total)
        .withColumn("_want", F.explode(wanted))
        .filter(
            (F.col("_want.at") >= F.col("_before"))
            & (F.col("_want.at") < F.col("_before") + F.col("_n"))
        )
        .select("_chunk", "_before", F.col("_want.pick").alias("pick"), F.col("_want.at").alias("_at"))
    )
    # Three rows at most: one per wanted position.
    placed = chunked.join(F.broadcast(hits.limit(3)), "_chunk")
    rank = F.row_number().over(Window.partitionBy("pick").orderBy(order)) - 1
    return (
        placed.withColumn("_rank", rank + F.col("_before"))
        .filter(F.col("_rank") == F.col("_at"))
        .select(*df.columns, "pick")
    )


def one_per_third(df: DataFrame, order: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """One random row from each third of the table in order."""
    counted = df.groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, [], order, ["n"])
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    placed = df.join(ranked.select(order, "n_before"), order).withColumn("_t", total)
    third = F.floor(F.col("n_before") * 3 / F.col("_t")).cast("int")
    draw = sample_order(*[F.col(k) for k in key], seed=seed)
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        placed.groupBy(third.alias("third")).agg(F.min_by(row, draw).alias("row")).select("third", "row.*")
    )
