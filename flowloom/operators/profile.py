"""Column profiles of flow tables: counts, shares, moments, quantiles, verdicts.

Every operator reads the table in one aggregation over all columns. Reports with
one line per column are made from that single row, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import (
    NUMERIC_TYPES,
    RISK_LEVELS,
    confidence_band,
    float_columns,
    is_infinite,
    is_missing,
    nan_to_null,
    numeric_columns,
)
from flowloom.operators.ordered import approximate_quantiles, exact_quantiles, long_form

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def per_column(
    df: DataFrame, columns: Sequence[str], measures: dict[str, callable], by: Sequence[str] = ()
) -> DataFrame:
    """One aggregation over all columns, turned into one row per column.

    ``measures`` maps result names to functions from a column name to an
    aggregate.
    """
    aggregates = [
        F.struct(
            F.lit(c).alias("feature"), *[make(c).alias(name) for name, make in measures.items()]
        ).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]
    wide = df.groupBy(*by).agg(*aggregates)
    rows = wide.select(*by, F.explode(F.array(*[f"m{i}" for i in range(len(columns))])).alias("m"))
    return rows.select(*by, "m.*")


def table_shape(df: DataFrame, order: str) -> DataFrame:
    """Per column: position, type, value in the first row; plus table size."""
    first = per_column(df, df.columns, {"first_value": lambda c: F.min_by(F.col(c), F.col(order)).cast("string")})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    positions = {c: i for i, c in enumerate(df.columns)}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    place = F.create_map(*[F.lit(x) for pair in positions.items() for x in pair])
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return first.select(
        place[F.col("feature")].alias("position"),
        F.col("feature").alias("column_name"),
        kind[F.col("feature")].alias("data_type"),
        "first_value",
        rows.alias("row_total"),
        F.lit(len(df.columns)).alias("column_total"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts and percent per value, missing values left out."""
    present = df.filter(~is_missing(df, column))
    total = present.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = present.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    result = counted.withColumn("percent", _share(F.col("n"), total))
    if top is not None:
        result = result.orderBy(F.col("n").desc(), F.col(column)).limit(top)
    return result


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class sizes, attack:benign ratio and the balance test (difference below 100)."""
    benign, attack = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    counts = df.agg(benign.alias("benign"), attack.alias("attack"))
    return counts.withColumns(
        {
            "attack_per_benign": F.when(
                F.col("benign") > 0, F.col("attack").cast("double") / F.col("benign")
            ),
            "is_balanced": F.abs(F.col("benign") - F.col("attack")) < 100,
        }
    )


def describe(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "exact"
) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column; missing values skipped.

    ``method="exact"`` ranks values in distributed buckets; ``"approx"`` uses a
    one-pass quantile sketch.
    """
    clean = nan_to_null(df)
    moments = per_column(
        clean,
        columns,
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(c),
            "std": lambda c: F.stddev_samp(c),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
        },
        by,
    )
    quantiles = quantile_ranges(clean, columns, by, method)
    return moments.join(quantiles, [*by, "feature"], "left").select(
        *by, "feature", "n", "mean", "std", "min", *QUARTILES, "max"
    )


def quantile_ranges(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "exact"
) -> DataFrame:
    """Quartiles per column (the normal range of a class)."""
    if method not in ("exact", "approx"):
        raise ValueError("method must be 'exact' or 'approx'")
    values = long_form(nan_to_null(df), columns, by)
    rank = exact_quantiles if method == "exact" else approximate_quantiles
    return rank(values, [*by, "feature"], "value", QUARTILES)


def mean_median_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    clean = nan_to_null(df)
    moments = per_column(
        clean,
        columns,
        {
            "mean": lambda c: F.avg(c),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
        },
    )
    median = exact_quantiles(long_form(clean, columns), ["feature"], "value", {"median": 0.5})
    return moments.join(median, "feature", "left").select("feature", "mean", "median", "min", "max")


def zero_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = per_column(
        df,
        columns,
        {
            "zeros": lambda c: F.count_if(F.col(c) == 0),
            "row_total": lambda c: F.count(F.lit(1)),
        },
    )
    return counts.select(
        "feature",
        "zeros",
        (F.col("row_total") - F.col("zeros")).alias("non_zeros"),
        _share(F.col("zeros"), F.col("row_total")).alias("zero_percent"),
    )


def zero_dominated(
    df: DataFrame, columns: Sequence[str], above_percent: float = 80.0, top: int = 10
) -> DataFrame:
    """Columns that are mostly zero, the worst first."""
    return (
        zero_counts(df, columns)
        .filter(F.col("zero_percent") > above_percent)
        .select("feature", "zero_percent")
        .orderBy(F.col("zero_percent").desc(), "feature")
        .limit(top)
    )


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counts = per_column(
        df,
        columns or df.columns,
        {
            "missing": lambda c: F.count_if(is_missing(df, c)),
            "row_total": lambda c: F.count(F.lit(1)),
        },
    )
    return counts.select(
        "feature", "missing", _share(F.col("missing"), F.col("row_total")).alias("missing_percent")
    )


def infinity_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    numeric = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    floats = set(float_columns(df))
    return per_column(
        df,
        numeric,
        {"infinite": lambda c: F.count_if(is_infinite(F.col(c))) if c in floats else F.count_if(F.lit(False))},
    )


def class_means(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean per class and their absolute difference."""
    clean = nan_to_null(df)
    means = per_column(
        clean,
        columns,
        {
            "benign_mean": lambda c: F.avg(F.when(F.col(label) == 0, F.col(c))),
            "attack_mean": lambda c: F.avg(F.when(F.col(label) == 1, F.col(c))),
        },
    )
    return means.withColumn(
        "difference", F.abs(F.col("benign_mean") - F.col("attack_mean"))
    )


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns without variation are useless to a model."""
    clean = nan_to_null(df)
    spread = per_column(
        clean,
        columns,
        {
            "std": lambda c: F.stddev_samp(c),
            "low": lambda c: F.min(F.col(c).cast("double")),
            "high": lambda c: F.max(F.col(c).cast("double")),
        },
    )
    return spread.withColumn("is_constant", F.coalesce(F.col("low") == F.col("high"), F.lit(True)))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column: distinct (column, value) pairs first, then a count."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    rows = nan_to_null(df).select(F.explode(pairs).alias("p")).select("p.feature", "p.value")
    counted = rows.filter(F.col("value").isNotNull()).distinct().groupBy("feature")
    return counted.agg(F.count(F.lit(1)).alias("distinct_values"))


def query_type_verdict(flows: DataFrame) -> DataFrame:
    """Do the flows show ANY or TXT questions at all?"""
    any_ratio, txt_ratio = F.col("dns_any_query_ratio"), F.col("dns_txt_query_ratio")
    found = flows.agg(
        F.count(F.lit(1)).alias("flow_total"),
        F.count_if(F.col("dns_total_queries") > 0).alias("dns_flows"),
        F.count_if(any_ratio > 0).alias("any_flows"),
        F.count_if(txt_ratio > 0).alias("txt_flows"),
        F.max(any_ratio).alias("any_max"),
        F.max(txt_ratio).alias("txt_max"),
    )
    passed = (F.col("any_flows") > 0) | (F.col("txt_flows") > 0)
    return found.withColumn("verdict", F.when(passed, "PASSED").otherwise("FAILED"))


def compare_sources(predictions: DataFrame, source: str = "source") -> DataFrame:
    """Per source: class counts and shares, confidence bands, mean confidence."""
    band = confidence_band(F.col("confidence"))
    counted = predictions.groupBy(source).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction") == 0).alias("benign"),
        F.count_if(F.col("prediction") == 1).alias("attack"),
        F.count_if(band == "high").alias("high_confidence"),
        F.count_if(band == "medium").alias("medium_confidence"),
        F.count_if(band == "low").alias("low_confidence"),
        F.avg("confidence").alias("mean_confidence"),
    )
    return counted.withColumns(
        {
            "benign_percent": _share(F.col("benign"), F.col("total")),
            "attack_percent": _share(F.col("attack"), F.col("total")),
        }
    )


def risk_distribution(report: DataFrame, column: str = "risk_level") -> DataFrame:
    """Rows per risk level in fixed order; empty levels are listed too."""
    counted = report.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == level).alias(level) for level in RISK_LEVELS],
    )
    levels = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(level).alias("risk_level"), F.col(level).alias("n"))
            for i, level in enumerate(RISK_LEVELS)
        ]
    )
    rows = counted.select("total", F.explode(levels).alias("l"))
    return rows.select(
        "l.position",
        "l.risk_level",
        "l.n",
        F.coalesce(_share(F.col("l.n"), F.col("total")), F.lit(0.0)).alias("percent"),
    )


# Timestamp column names in order of preference, and the text forms.
TIMESTAMP_COLUMNS = [
    "timestamp",
    "time",
    "flow_start_time",
    "start_time",
    "capture_time",
    "flow_timestamp",
]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def time_range(df: DataFrame) -> DataFrame:
    """One row ``timestamp_range``: "<first> to <last>" of the first known time column.

    Unparsable times are skipped; with no usable time it is the detection time.
    """
    now = F.concat(F.lit("Detection Time: "), F.date_format(F.current_timestamp(), TIME_FORMAT))
    column = next((c for c in TIMESTAMP_COLUMNS if c in df.columns), None)
    if column is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select(now.alias("timestamp_range"))
    parsed = F.col(column).cast("string").try_cast("timestamp_ntz")
    bounds = df.agg(F.min(parsed).alias("low"), F.max(parsed).alias("high"))
    text = F.concat(
        F.date_format("low", TIME_FORMAT), F.lit(" to "), F.date_format("high", TIME_FORMAT)
    )
    return bounds.select(F.coalesce(text, now).alias("timestamp_range"))


def baseline_statistics(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """Long table ``(feature, stat, value)`` to store as the baseline of a class."""
    wide = describe(df, columns, method=method).drop("n")
    stats = [c for c in wide.columns if c != "feature"]
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats])
    return wide.select("feature", F.explode(pairs).alias("p")).select("feature", "p.stat", "p.value")


def baseline_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The means of :func:`baseline_statistics` alone, without ranking any value."""
    means = per_column(nan_to_null(df), columns, {"value": lambda c: F.avg(c)})
    return means.select("feature", F.lit("mean").alias("stat"), "value")


def compare_with_baseline(batch: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of a batch against the stored baseline means, per feature."""
    clean = nan_to_null(batch)
    means = per_column(clean, columns, {"test_mean": lambda c: F.avg(c)})
    stored = baseline.filter(F.col("stat") == "mean").select(
        "feature", F.col("value").alias("baseline_mean")
    )
    return stored.join(means, "feature").withColumn(
        "difference", F.abs(F.col("baseline_mean") - F.col("test_mean"))
    )


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)
