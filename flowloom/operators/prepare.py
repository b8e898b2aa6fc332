"""Dataset preparation: cleaning, alignment, labelling, union, balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.columns import float_columns, is_infinite
from flowloom.operators.profile import class_balance
from flowloom.operators.sampling import balance_classes, shuffle_rows
from flowloom.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS

# Rows to keep of the three flood classes, and the shuffle seed.
FLOOD_QUOTAS = {
    "DDoS_SynonymousIP_Flood": 19012,
    "DDoS_SYN_Flood": 191963,
    "DDoS_TCP_Flood": 138520,
}
SEED = 42
LABEL_CODES = {"BENIGN": 0, "ATTACK": 1}


def drop_identity(df: DataFrame) -> DataFrame:
    return df.drop(*IDENTITY_COLUMNS)


def clean_values(df: DataFrame, inf_value: float | None = None, fill: float = 0.0) -> DataFrame:
    """Infinities become ``inf_value`` (missing by default), missing values ``fill``."""
    known = inf_value is not None and not math.isnan(inf_value)

    def finite(name: str, kind: T.DataType) -> Column:
        # One comparison tells finite values: it fails for NULL, NaN (the largest value) and infinities.
        # A test for each makes the generated method of a wide table too long for the JVM to compile.
        value = F.col(name)
        kept = F.when(F.abs(value) < F.lit(float("inf")), value)
        if known:
            kept = kept.when(is_infinite(value), F.lit(inf_value))
        return kept.otherwise(F.lit(fill).cast(kind if inf_value is None else T.DoubleType())).alias(name)

    floats = set(float_columns(df))
    cleaned = df.select([finite(f.name, f.dataType) if f.name in floats else F.col(f.name) for f in df.schema.fields])
    others = [f.name for f in df.schema.fields if f.name not in floats]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    filled = cleaned.na.fill(fill, subset=others) if others else cleaned
    return filled.na.fill("0", subset=text) if text else filled


def align_features(
    df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly the given features in order: missing ones as 0, others dropped."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features],
        *[c for c in keep if c in df.columns and c not in features],
    )


def alignment_report(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> dict:
    """Names missing from or foreign to the features, and identity names left in.

    The name test looks for 'ip' and 'port' in the name, so it also lists
    ``port_53_traffic_ratio``.
    """
    present = [c for c in df.columns if c != "label"]
    return {
        "expected": len(features),
        "found": len(present),
        "missing": sorted(set(features) - set(present)),
        "extra": sorted(set(present) - set(features)),
        "identity_like": [c for c in present if "ip" in c.lower() or "port" in c.lower()],
    }


def alignment_rows(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """:func:`alignment_report` with the data: a row per name, how it stands, and its present values."""
    from flowloom.operators.profile import per_column

    report = alignment_report(df, features)
    foreign = set(report["extra"])
    present = [c for c in df.columns if c != "label"]
    counts = per_column(df, present, {"present": lambda c: F.count(c)})
    standing = F.when(F.col("feature").isin(list(foreign)), "extra").otherwise("expected")
    found = counts.select(
        "feature",
        standing.alias("standing"),
        F.col("feature").isin(report["identity_like"]).alias("identity_like"),
        "present",
    )
    if not report["missing"]:
        return found
    lost = F.explode(F.array(*[F.lit(c) for c in report["missing"]])).alias("feature")
    one = df.sparkSession.range(1).select(lost)
    return found.unionByName(
        one.select(
            "feature", F.lit("missing").alias("standing"), F.lit(False).alias("identity_like"), F.lit(0).cast("bigint").alias("present")
        )
    )


def encode_label(df: DataFrame, label: str = "label") -> DataFrame:
    """ATTACK/BENIGN text to 1/0."""
    code = F.lit(None).cast("int")
    for text, value in LABEL_CODES.items():
        code = F.when(F.col(label) == text, value).otherwise(code)
    return df.withColumn(label, code)


def with_constant_label(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.lit(value))


def only_class(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == value)


def dns_rich(flows: DataFrame, above: int = 5) -> DataFrame:
    """Flows with more than five queries and more than five responses."""
    return flows.filter(
        (F.col("dns_total_queries") > above) & (F.col("dns_total_responses") > above)
    )


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns absent from one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def build_dataset(
    attacks: DataFrame,
    benign: DataFrame,
    key: Sequence[str],
    source: str = "source",
    quotas: dict[str, int] | None = None,
    seed: int = SEED,
    shuffled: bool = True,
) -> DataFrame:
    """Balance the flood sources, label both sides, unite and shuffle.

    One lazy plan. A single seeded shuffle stands for the three rounds of the
    original work: shuffling again leaves rows equally mixed.
    """
    balanced = balance_classes(attacks, source, quotas or FLOOD_QUOTAS, key, seed)
    united = union_all([with_constant_label(balanced, 1), with_constant_label(benign, 0)])
    return shuffle_rows(united, key, seed) if shuffled else united


def dataset_statistics(df: DataFrame) -> DataFrame:
    return class_balance(df).withColumns(
        {
            "total": F.col("benign") + F.col("attack"),
            "benign_percent": F.when(
                F.col("benign") + F.col("attack") > 0,
                F.col("benign") * 100.0 / (F.col("benign") + F.col("attack")),
            ),
        }
    )


def numeric_if_all_parse(df: DataFrame) -> DataFrame:
    """Turn a text column into double if every present value parses; one pass decides.

    The decision is one row of counts, so this runs a job when called.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    checks = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
            for c in text
        ]
    ).first()
    numeric = {c for c in text if checks[c] == 0}
    return df.select(
        [F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns]
    )


def parse_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: present values, values that parse as a number, the verdict."""
    from flowloom.operators.profile import per_column

    counts = per_column(
        df,
        columns,
        {
            "present": lambda c: F.count(c),
            "parsed": lambda c: F.count(F.col(c).try_cast("double")),
        },
    )
    return counts.withColumn("is_numeric", F.col("present") == F.col("parsed"))
