"""Repair of flow exports whose rows do not fit their header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import FLOW_COLUMNS, FLOW_TYPES

_WIDTH = len(FLOW_COLUMNS)


def _fields(line: Column) -> Column:
    return F.split(line, ",")


def line_status(line: Column) -> Column:
    """What is wrong with an export line.

    ``ok``: 40 fields. ``trailing``: a 41st, empty field. ``indexed``: 41 fields
    with an extra first one. ``header``: the line names the columns.
    ``malformed``: anything else.
    """
    fields = _fields(line)
    is_header = (F.get(fields, F.lit(4)) == "protocol") | (F.get(fields, F.lit(5)) == "protocol")
    return (
        F.when(F.coalesce(is_header, F.lit(False)), "header")
        .when(F.size(fields) == _WIDTH, "ok")
        .when((F.size(fields) == _WIDTH + 1) & (F.element_at(fields, -1) == ""), "trailing")
        .when(F.size(fields) == _WIDTH + 1, "indexed")
        .otherwise("malformed")
    )


def repair_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed 40-column rows of the repairable lines, with what was repaired.

    Values that do not parse become NULL; they are visible to the profile
    operators and not silently zero.
    """
    marked = lines.withColumn("repair", line_status(F.col(column))).filter(
        F.col("repair").isin("ok", "trailing", "indexed")
    )
    fields = _fields(F.col(column))
    start = F.when(F.col("repair") == "indexed", 2).otherwise(1)
    marked = marked.withColumn("fields", F.slice(fields, start, _WIDTH))
    return marked.select(
        *[F.col("fields")[i].try_cast(FLOW_TYPES[c]).alias(c) for i, c in enumerate(FLOW_COLUMNS)],
        "repair",
    )


def repair_summary(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.groupBy(line_status(F.col(column)).alias("status")).agg(
        F.count(F.lit(1)).alias("line_total")
    )


def drop_malformed(lines: DataFrame, column: str = "value", width: int = _WIDTH) -> DataFrame:
    """Keep only lines with the expected number of fields."""
    return lines.filter(F.size(_fields(F.col(column))) == width)


def shift_check(flows: DataFrame) -> DataFrame:
    """Share of rows that look shifted by one column.

    ``dst_ip`` then holds a port number and ``protocol`` a decimal number.
    """
    integer_ip = F.col("dst_ip").cast("string").rlike(r"^\d+$")
    numeric_protocol = F.col("protocol").cast("string").try_cast("double").isNotNull()
    counted = flows.agg(
        F.count(F.lit(1)).alias("row_total"),
        F.count_if(integer_ip).alias("integer_dst_ip"),
        F.count_if(numeric_protocol).alias("numeric_protocol"),
        F.count_if(~F.col("protocol").isin("TCP", "UDP")).alias("foreign_protocol"),
    )
    names_ok = flows.columns[:5] == FLOW_COLUMNS[:5]
    return counted.withColumns(
        {
            "names_as_expected": F.lit(names_ok),
            "is_shifted": (F.col("integer_dst_ip") > 0) | (F.col("numeric_protocol") > 0),
        }
    )


def rename_by_position(table: DataFrame) -> DataFrame:
    """Undo a shift: the first 40 columns are the flow columns, whatever their names.

    A shifted table has the true first field in a leading index column.
    """
    pairs = zip(table.columns, FLOW_COLUMNS, strict=False)
    return table.select([F.col(f"`{found}`").alias(name) for found, name in pairs])


# Names of the older export and what they are called now.
LEGACY_NAMES = {
    "Src IP": "src_ip",
    "Dst IP": "dst_ip",
    "Src Port": "src_port",
    "Dst Port": "dst_port",
    "Protocol": "protocol",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "total_fwd_packets",
    "Tot Bwd Pkts": "total_bwd_packets",
    "Flow Len Mean": "average_packet_size",
    "Flow Len Std": "packet_size_std",
    "Flow Len Max": "flow_length_max",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "queries_per_second": "dns_queries_per_second",
    "dns_response_size": "dns_response_bytes",
}


def from_legacy_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in LEGACY_NAMES.items() if k in df.columns})


def to_legacy_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in LEGACY_NAMES.items() if v in df.columns})
