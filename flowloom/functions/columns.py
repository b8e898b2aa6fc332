"""Reusable column expressions; all built-in, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def or_zero_double(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, 0.0 where the divisor is not positive."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def seconds_floor(duration_ms: Column) -> Column:
    """Duration in seconds for rates; flows of no length count as one second."""
    return F.when(duration_ms <= 0, F.lit(1.0)).otherwise(duration_ms / F.lit(1000.0))


def fixed4(value: Column) -> Column:
    """Four decimals, as the flow export prints them."""
    return F.format_string("%.4f", value.cast("double"))


def endpoint(ip: str, port: str) -> Column:
    return F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))


def endpoint_text(ep: str) -> Column:
    return F.concat_ws(":", F.col(f"{ep}.ip"), F.col(f"{ep}.port").cast("string"))


def occurrences(array: Column, value: int) -> Column:
    """How often ``value`` occurs; 0 for no array.

    ``filter`` is not part of a stage's single generated method, so a projection with it is generated
    in short methods of its own. Where a long chain ends in ``array_remove``, the method grows beyond
    8000 bytes, which the JVM does not compile.
    """
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(F.filter(array, lambda x: x == value)))


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL or, for floating columns, NaN."""
    if name in float_columns(df):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def nan_to_null(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """NaN is a value to Spark but missing data to the profile operators."""
    names = set(float_columns(df) if names is None else names)
    return df.select(
        [
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in names else F.col(c)
            for c in df.columns
        ]
    )


def label_text(label: Column) -> Column:
    return F.when(label == 0, "BENIGN").when(label == 1, "ATTACK")


# Lower bounds of the risk levels, highest first.
RISK_BOUNDS = [("CRITICAL", 0.90), ("HIGH", 0.80), ("MEDIUM", 0.60)]
RISK_REST = "LOW"
RISK_LEVELS = [name for name, _ in RISK_BOUNDS] + [RISK_REST]


def risk_level(confidence: Column) -> Column:
    level = F.lit(RISK_REST)
    for name, bound in reversed(RISK_BOUNDS):
        level = F.when(confidence >= bound, name).otherwise(level)
    return level


# Confidence bands; the middle band holds both of its bounds.
BAND_HIGH = 0.9
BAND_LOW = 0.7


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence > BAND_HIGH, "high")
        .when(confidence >= BAND_LOW, "medium")
        .otherwise("low")
    )


# Spellings of a DNS flag in packet extracts.
FLAG_FALSE = ["0", "False", "0x0"]
FLAG_TRUE = ["1", "True", "0x1"]


def dns_flag(text: Column) -> Column:
    return F.when(text.isin(FLAG_TRUE), True).when(text.isin(FLAG_FALSE), False)


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def sample_order(*keys: Column, seed: int = 42) -> Column:
    """A reproducible pseudo-random order: the md5 text of the row id and a seed."""
    parts = [k.cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def renamed_output(path: Column, old_suffix: str, new_suffix: str) -> Column:
    return F.regexp_replace(path, old_suffix.replace(".", r"\.") + "$", new_suffix)


def epoch_ms_to_timestamp(ms: Column) -> Column:
    """UTC wall-clock time, whatever the time zone of the session is."""
    seconds = (ms.cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    names = set(float_columns(df))
    return df.select([F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])
