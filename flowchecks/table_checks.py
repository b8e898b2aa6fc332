"""Checked queries on flow tables: sources, sinks, cleaning, profiles, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowchecks.base import (
    ALL_FLOW_COLUMNS,
    FLOW_HANDLE,
    WITH_FLOWS,
    check,
    coded,
    flow_sql,
    flow_table,
    r4,
    sql_columns,
    unpivot_sql,
)
from flowloom.functions.columns import epoch_ms_to_timestamp, label_text
from flowloom.operators import ordered, prepare, profile, repair, sampling
from flowloom.plans.flow_tables import scratch_folder
from flowloom.schemas import FEATURE_COLUMNS, FLOW_COLUMNS, FLOW_FIELDS, IDENTITY_COLUMNS
from flowloom.sources import flow_csv, sinks

SOME = [
    "dns_amplification_factor",
    "query_response_ratio",
    "dns_any_query_ratio",
    "dns_queries_per_second",
    "dns_total_queries",
    "dns_total_responses",
    "flow_bytes_per_sec",
    "port_53_traffic_ratio",
    "flow_duration",
    "dns_server_fanout",
]

_NUMERIC = [c for c in FEATURE_COLUMNS if c != "protocol"]

# The 40 columns as export text in SQL; rounding first avoids different ties.
_TEXT = {
    c: f"printf('%.4f', round({c}, 4))"
    for c, t in FLOW_FIELDS
    if t == "double" and c not in sinks.RAW_DOUBLES
}
_LINE = " || ',' || ".join(_TEXT.get(c, f"cast({c} as varchar)") for c in FLOW_COLUMNS)
_WITH_LINES = f"{WITH_FLOWS}, tl as (select *, {_LINE} as line from fl)"


# --- sources and sinks -------------------------------------------------------


@check("s02_flow_csv_scan", f"{WITH_FLOWS} select {sql_columns(FLOW_COLUMNS)} from fl")
def flow_csv_scan(spark, sf_dir):
    folder = scratch_folder(spark, "scan")
    sinks.write_flow_csv(flow_table(spark, sf_dir), folder)
    return flow_csv.read_flows(spark, folder).select(*FLOW_COLUMNS)


@check("s02_labelled_csv_scan", f"{WITH_FLOWS} select label, count(*) as n, cast(sum(flow_duration) as bigint) as duration from fl group by label")
def labelled_csv_scan(spark, sf_dir):
    folder = scratch_folder(spark, "scan")
    sinks.write_flow_csv(flow_table(spark, sf_dir), folder, labelled=True)
    flows = flow_csv.read_flows(spark, folder, labelled=True)
    return flows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_duration").alias("duration"))


@check(
    "s03_first_rows",
    f"{WITH_FLOWS} select {sql_columns([*FLOW_HANDLE, *SOME])} from fl order by first_seq limit 1000",
)
def first_rows(spark, sf_dir):
    flows = sampling.first_rows(flow_table(spark, sf_dir), 1000, ["first_seq"])
    return flows.select(*FLOW_HANDLE, *SOME)


@check(
    "s04_numeric_columns",
    f"""{WITH_FLOWS}, t as (select src_ip, protocol, cast(src_port as varchar) as src_port,
      case when flow_no % 7 = 0 then 'n/a' else cast(dst_port as varchar) end as dst_port from fl)
    select c as feature, count(v) as present, count(try_cast(v as double)) as parsed,
      count(v) = count(try_cast(v as double)) as is_numeric
    from (select unnest(['src_ip', 'protocol', 'src_port', 'dst_port']) as c,
      unnest([src_ip, protocol, src_port, dst_port]) as v from t) group by c""",
)
def numeric_columns(spark, sf_dir):
    text = flow_table(spark, sf_dir).select(
        "src_ip",
        "protocol",
        F.col("src_port").cast("string").alias("src_port"),
        F.when(F.col("flow_no") % 7 == 0, "n/a")
        .otherwise(F.col("dst_port").cast("string"))
        .alias("dst_port"),
    )
    return prepare.parse_counts(text, text.columns)


@check(
    "s04_coerced_table",
    f"""{WITH_FLOWS} select capture_id, cast(first_seq as double) as first_seq, src_ip, cast(src_port as double) as src_port,
      case when flow_no % 7 = 0 then 'n/a' else cast(dst_port as varchar) end as dst_port,
      cast(total_fwd_packets as double) as total_fwd_packets, true as is_coerced from fl""",
)
def coerced_table(spark, sf_dir):
    """A CSV without a schema: columns whose values all parse become numbers, the others stay text."""
    folder = scratch_folder(spark, "untyped")
    mixed = F.when(F.col("flow_no") % 7 == 0, "n/a").otherwise(F.col("dst_port").cast("string")).alias("dst_port")
    flows = flow_table(spark, sf_dir)
    flows.select("capture_id", "first_seq", "src_ip", "src_port", mixed, "total_fwd_packets").write.option("header", True).csv(folder)
    table = flow_csv.read_untyped(spark, folder)
    kinds = {"first_seq": "double", "src_port": "double", "total_fwd_packets": "double", "src_ip": "string", "dst_port": "string"}
    return table.withColumn("is_coerced", F.lit(all(dict(table.dtypes)[c] == kind for c, kind in kinds.items())))


@check(
    "s05_read_present",
    f"""{WITH_FLOWS} select capture_id || '.csv' as source, src_ip, src_port, dst_ip, dst_port, protocol, flow_duration,
      1 as missing from fl""",
)
def read_present_files(spark, sf_dir):
    """All files that exist as one table with their names; the one that does not exist is counted."""
    from pyspark.sql import DataFrame

    folder = scratch_folder(spark, "present")

    def write(flows: DataFrame, name: str) -> None:
        # One file per capture, written in parts below a folder of its name.
        flows.filter(F.col("capture_id") == name).select(*FLOW_COLUMNS).write.option("header", True).csv(f"{folder}/{name}.csv")

    for name in ("cap0", "cap1"):
        write(flow_table(spark, sf_dir), name)
    flows, missing = flow_csv.read_present(spark, [f"{folder}/{n}.csv" for n in ("cap0", "cap1", "cap9")])
    source = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+[.]csv)/", 1)
    return flows.withColumn("source", source).select(
        "source", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flow_duration", F.lit(len(missing)).alias("missing")
    )


@check(
    "s05_present_files",
    f"""{WITH_FLOWS} select capture_id as source, count(*) as row_total from fl group by capture_id
    union all select 'missing', 1""",
)
def present_files(spark, sf_dir):
    folder = scratch_folder(spark, "files")
    flows = flow_table(spark, sf_dir)
    flows.select("capture_id", *FLOW_COLUMNS).write.partitionBy("capture_id").option(
        "header", True
    ).csv(folder)
    paths = [f"{folder}/capture_id={name}" for name in ("cap0", "cap1", "cap9")]
    found, missing = flow_csv.existing_paths(spark, paths)
    table = flow_csv.read_flows(spark, found)
    source = F.regexp_extract(F.col("_metadata.file_path"), "capture_id=([^/]+)", 1)
    counted = flow_csv.rows_per_file(table.withColumn("source", source))
    lost = spark.range(1).select(F.lit("missing").alias("source"), F.lit(len(missing)).cast("bigint").alias("row_total"))
    return counted.unionByName(lost)


@check("s06_export_lines", f"{_WITH_LINES} select line || ',' || label as line from tl")
def export_lines(spark, sf_dir):
    return sinks.export_lines(flow_table(spark, sf_dir), labelled=True)


@check("s06_export_lines_unlabelled", f"{_WITH_LINES} select line from tl")
def export_lines_unlabelled(spark, sf_dir):
    return sinks.export_lines(flow_table(spark, sf_dir), labelled=False)


@check(
    "s07_two_sinks",
    f"{WITH_FLOWS} select capture_id, count(*) as n, cast(sum(total_fwd_packets) as bigint) as packets from fl group by capture_id",
)
def two_sinks(spark, sf_dir):
    folder = scratch_folder(spark, "tee")

    def broken(*_):
        raise ConnectionError("second sink is not reachable")

    write = sinks.tee(sinks.folder_sink(folder), broken)
    write(flow_table(spark, sf_dir))
    back = spark.read.parquet(folder)
    return back.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_fwd_packets").alias("packets")
    )


@check(
    "s08_append",
    f"{WITH_FLOWS} select capture_id, 2 * count(*) as n from fl group by capture_id",
)
def append_twice(spark, sf_dir):
    folder = scratch_folder(spark, "append")
    flows = flow_table(spark, sf_dir)
    sinks.write_flows(flows, folder)
    sinks.write_flows(flows, folder)
    return spark.read.parquet(folder).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "s09_prediction_sink",
    f"{WITH_FLOWS} select prediction, count(*) as n from fx group by prediction",
)
def prediction_sink(spark, sf_dir):
    rows = coded(spark, sf_dir).select("prediction", "score")
    target = sinks.write_predictions(rows, scratch_folder(spark, "predictions"), kind="parquet")
    return spark.read.parquet(target).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@check(
    "s10_paired_sinks",
    f"""{WITH_FLOWS} select 'labelled' as sink, count(*) as n, count(label) as labels from fl
    union all select 'plain', count(*), 0 from fl""",
)
def paired_sinks(spark, sf_dir):
    labelled, plain = scratch_folder(spark, "labelled"), scratch_folder(spark, "plain")
    rows = flow_table(spark, sf_dir).select("src_ip", "flow_duration", "label")
    sinks.write_pair(rows, labelled, plain)
    one = spark.read.option("header", True).csv(labelled)
    two = spark.read.option("header", True).csv(plain)
    counts = one.agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"))
    other = two.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("labels"))
    first = counts.select(F.lit("labelled").alias("sink"), "n", "labels")
    return first.unionByName(other.select(F.lit("plain").alias("sink"), "n", "labels"))


def _baseline_sql(source: str, where: str) -> str:
    stats = {
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "cast(min({c}) as double)",
        "q25": "quantile_cont(cast({c} as double), 0.25)",
        "q50": "quantile_cont(cast({c} as double), 0.5)",
        "q75": "quantile_cont(cast({c} as double), 0.75)",
        "max": "cast(max({c}) as double)",
    }
    rows = [
        f"select '{c}' as feature, '{s}' as stat, round({e.replace('{c}', c)}, 4) as value from {source} {where}"
        for c in _NUMERIC
        for s, e in stats.items()
    ]
    return f"{WITH_FLOWS} " + " union all ".join(rows)


@check("s12_baseline_statistics", _baseline_sql("fl", "where y = 0"))
def baseline_statistics(spark, sf_dir):
    folder = scratch_folder(spark, "baseline")
    benign = prepare.only_class(coded(spark, sf_dir), 0)
    sinks.write_baseline(profile.baseline_statistics(benign, _NUMERIC), folder)
    return spark.read.parquet(folder)


# --- filters and cleaning ----------------------------------------------------


@check("f04_benign_only", flow_sql(["flow_duration", "src_ip"], tail="where y = 0"))
def benign_only(spark, sf_dir):
    return prepare.only_class(coded(spark, sf_dir), 0).select(*FLOW_HANDLE, "flow_duration", "src_ip")


@check(
    "f05_dns_rich",
    flow_sql(
        ["dns_total_queries", "dns_total_responses"],
        tail="where dns_total_queries > 1 and dns_total_responses > 1",
    ),
)
def dns_rich(spark, sf_dir):
    flows = prepare.dns_rich(flow_table(spark, sf_dir), above=1)
    return flows.select(*FLOW_HANDLE, "dns_total_queries", "dns_total_responses")


@check("f07_drop_identity", f"{WITH_FLOWS} select {sql_columns(FEATURE_COLUMNS)} from fl")
def drop_identity(spark, sf_dir):
    return prepare.drop_identity(flow_table(spark, sf_dir).select(*FLOW_COLUMNS))


@check(
    "f08_hidden_columns",
    f"""{WITH_FLOWS} select {sql_columns([c for c in ALL_FLOW_COLUMNS if c not in ('ttl_violation_rate', 'dns_server_fanout')])} from fl""",
)
def hidden_columns(spark, sf_dir):
    return flow_table(spark, sf_dir).select(*FLOW_COLUMNS).drop("ttl_violation_rate", "dns_server_fanout")


def _dirty(flows):
    """Infinite, NaN and NULL values in known places."""
    infinite = F.when(F.col("flow_no") % 5 == 0, F.lit(float("inf"))).when(
        F.col("flow_no") % 5 == 1, F.lit(float("-inf"))
    )
    return flows.select(
        *FLOW_HANDLE,
        F.coalesce(infinite, F.col("flow_bytes_per_sec")).alias("rate"),
        F.when(F.col("flow_no") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("share"),
        F.when(F.col("flow_no") % 4 != 0, F.col("total_fwd_packets")).alias("fwd"),
        F.when(F.col("flow_no") % 6 != 0, F.col("protocol")).alias("kind"),
    )


_DIRTY = f"""{WITH_FLOWS}, dt as (select capture_id, first_seq,
  case flow_no % 5 when 0 then 'Infinity'::double when 1 then '-Infinity'::double
    else flow_bytes_per_sec end as rate,
  case when flow_no % 3 = 0 then 'NaN'::double else score end as share,
  case when flow_no % 4 <> 0 then total_fwd_packets end as fwd,
  case when flow_no % 6 <> 0 then protocol end as kind from fl)"""


@check(
    "f09_clean_values",
    f"""{_DIRTY} select capture_id, first_seq,
     {r4("case when isinf(rate) then 0 else rate end", "rate")},
     {r4("case when isnan(share) then 0 else share end", "share")},
     coalesce(fwd, 0) as fwd, coalesce(kind, '0') as kind from dt""",
)
def clean_values(spark, sf_dir):
    return prepare.clean_values(_dirty(flow_table(spark, sf_dir)))


@check(
    "f10_aligned_features",
    f"""{WITH_FLOWS} select {sql_columns([c for c in FEATURE_COLUMNS if c not in ('flow_iat_std', 'protocol')])},
     protocol, round(0.0::double, 4) as flow_iat_std, y as label from fl""",
)
def aligned_features(spark, sf_dir):
    flows = coded(spark, sf_dir).drop("flow_iat_std").withColumn("extra", F.lit(1))
    return prepare.align_features(flows, keep=["label"])


@check(
    "f10_alignment_rows",
    f"""{WITH_FLOWS}, n as (select count(*) as c from fl)
    select unnest([{', '.join(f"'{c}'" for c in [*FEATURE_COLUMNS, 'extra_ip'] if c != 'flow_iat_std')}]) as feature, c as present
    from n""".replace("select unnest", "select feature, case when feature = 'extra_ip' then 'extra' else 'expected' end as standing, "
    "contains(feature, 'ip') or contains(feature, 'port') as identity_like, present from (select unnest")
    + ") union all select 'flow_iat_std', 'missing', false, 0",
)
def alignment_rows(spark, sf_dir):
    flows = coded(spark, sf_dir).select(*[c for c in FEATURE_COLUMNS if c != "flow_iat_std"], "label")
    return prepare.alignment_rows(flows.withColumn("extra_ip", F.lit(1)))


@check(
    "f11_label_codes",
    f"{WITH_FLOWS} select capture_id, first_seq, y as label, 1 as constant_label from fl",
)
def label_codes(spark, sf_dir):
    flows = prepare.encode_label(flow_table(spark, sf_dir))
    flows = prepare.with_constant_label(flows, 1, "constant_label")
    return flows.select(*FLOW_HANDLE, "label", "constant_label")


@check(
    "f12_label_text",
    f"{WITH_FLOWS} select capture_id, first_seq, case when y = 0 then 'BENIGN' else 'ATTACK' end as label_name from fl",
)
def label_names(spark, sf_dir):
    return coded(spark, sf_dir).select(*FLOW_HANDLE, label_text(F.col("label")).alias("label_name"))


# --- profiles ----------------------------------------------------------------


def _first_value(name: str) -> str:
    """The first value as text; doubles are left to the other checks, their text differs by engine."""
    return "null" if dict(FLOW_FIELDS)[name] == "double" else f"cast({name} as varchar)"


@check(
    "p01_table_shape",
    f"""{WITH_FLOWS}, o as (select * from fl order by first_seq limit 1), n as (select count(*) as c from fl) """
    + " union all ".join(
        f"select {i} as position, '{c}' as column_name, '{t}' as data_type, {_first_value(c)} as first_value, c as row_total, {len(FLOW_FIELDS) + 1} as column_total from o, n"
        for i, (c, t) in enumerate([*FLOW_FIELDS])
    )
    + f" union all select {len(FLOW_FIELDS)}, 'first_seq', 'bigint', cast(first_seq as varchar), c, {len(FLOW_FIELDS) + 1} from o, n",
)
def table_shape(spark, sf_dir):
    flows = flow_table(spark, sf_dir).select(*FLOW_COLUMNS, "first_seq")
    shape = profile.table_shape(flows, "first_seq")
    return shape.withColumn("first_value", F.when(F.col("data_type") != "double", F.col("first_value")))


@check(
    "p02_value_counts",
    f"""{WITH_FLOWS} select label, count(*) as n,
     round(count(*) * 100.0 / (select count(*) from fl), 4) as percent from fl group by label""",
)
def value_counts(spark, sf_dir):
    return profile.value_counts(flow_table(spark, sf_dir), "label")


@check(
    "p03_class_ratio",
    f"""{WITH_FLOWS} select count(*) filter (where y = 0) as benign,
     count(*) filter (where y = 1) as attack,
     round(count(*) filter (where y = 1) / cast(count(*) filter (where y = 0) as double), 4)
       as attack_per_benign from fl""",
)
def class_ratio(spark, sf_dir):
    return profile.class_balance(coded(spark, sf_dir)).drop("is_balanced")


@check(
    "p04_balance_test",
    f"""{WITH_FLOWS} select abs(count(*) filter (where y = 0) - count(*) filter (where y = 1)) < 100
      as is_balanced from fl""",
)
def balance_test(spark, sf_dir):
    return profile.class_balance(coded(spark, sf_dir)).select("is_balanced")


_DESCRIBE = """count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round(cast(min({c}) as double), 4) as min, round(quantile_cont(cast({c} as double), 0.25), 4) as q25,
  round(quantile_cont(cast({c} as double), 0.5), 4) as q50,
  round(quantile_cont(cast({c} as double), 0.75), 4) as q75,
  round(cast(max({c}) as double), 4) as max"""


@check("p05_describe", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _DESCRIBE)}")
def describe(spark, sf_dir):
    return profile.describe(flow_table(spark, sf_dir), _NUMERIC)


@check("p05_describe_by_class", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, 'label, ' + _DESCRIBE, ' group by label')}")
def describe_by_class(spark, sf_dir):
    return profile.describe(flow_table(spark, sf_dir), _NUMERIC, by=["label"])


@check(
    "p05_describe_sketch",
    f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, 'count({c}) as n, true as q25_ok, true as q50_ok, true as q75_ok')}",
)
def describe_sketch(spark, sf_dir):
    """Whether the ranks of the sketch's quartiles are within its error bound."""
    flows = flow_table(spark, sf_dir)
    sketch = profile.describe(flows, _NUMERIC, method="approx").select("feature", *profile.QUARTILES)
    values = ordered.long_form(flows, _NUMERIC).join(F.broadcast(sketch), "feature")
    rows = F.count(F.lit(1))

    def within(name, p):
        below, upto = (F.count_if(F.col("value") < F.col(name)), F.count_if(F.col("value") <= F.col(name)))
        slack = rows / 10000.0 + 1
        return ((below <= rows * p + slack) & (upto >= rows * p - slack)).alias(f"{name}_ok")

    checks = [within(name, p) for name, p in profile.QUARTILES.items()]
    return values.groupBy("feature").agg(rows.alias("n"), *checks)


_ZEROS = """count(*) filter (where {c} = 0) as zeros, count(*) - count(*) filter (where {c} = 0)
  as non_zeros, round(count(*) filter (where {c} = 0) * 100.0 / count(*), 4) as zero_percent"""


@check("p06_zero_counts", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _ZEROS)}")
def zero_counts(spark, sf_dir):
    return profile.zero_counts(flow_table(spark, sf_dir), _NUMERIC)


@check(
    "p07_zero_dominated",
    f"""{WITH_FLOWS}, z as ({unpivot_sql('fl', _NUMERIC, "round(count(*) filter (where {c} = 0) * 100.0 / count(*), 4) as zero_percent")})
    select * from z where zero_percent > 80 order by zero_percent desc, feature limit 10""",
)
def zero_dominated(spark, sf_dir):
    return profile.zero_dominated(flow_table(spark, sf_dir), _NUMERIC)


@check(
    "p08_missing_counts",
    f"""{_DIRTY} select 'rate' as feature, count(*) filter (where rate is null or isnan(rate)) as missing,
      round(count(*) filter (where rate is null or isnan(rate)) * 100.0 / count(*), 4) as missing_percent from dt
    union all select 'share', count(*) filter (where share is null or isnan(share)),
      round(count(*) filter (where share is null or isnan(share)) * 100.0 / count(*), 4) from dt
    union all select 'fwd', count(*) - count(fwd), round((count(*) - count(fwd)) * 100.0 / count(*), 4) from dt
    union all select 'kind', count(*) - count(kind), round((count(*) - count(kind)) * 100.0 / count(*), 4) from dt""",
)
def missing_counts(spark, sf_dir):
    return profile.missing_counts(_dirty(flow_table(spark, sf_dir)).drop(*FLOW_HANDLE))


@check(
    "p09_infinity_counts",
    f"""{_DIRTY} select 'rate' as feature, count(*) filter (where isinf(rate)) as infinite from dt
    union all select 'share', count(*) filter (where isinf(share)) from dt
    union all select 'fwd', 0 from dt group by 1""",
)
def infinity_counts(spark, sf_dir):
    return profile.infinity_counts(_dirty(flow_table(spark, sf_dir)).drop(*FLOW_HANDLE))


_QUARTILES = """round(quantile_cont(cast({c} as double), 0.25), 4) as q25,
  round(quantile_cont(cast({c} as double), 0.5), 4) as q50,
  round(quantile_cont(cast({c} as double), 0.75), 4) as q75"""


@check("p10_normal_ranges", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _QUARTILES, ' where y = 0')}")
def normal_ranges(spark, sf_dir):
    return profile.quantile_ranges(prepare.only_class(coded(spark, sf_dir), 0), _NUMERIC)


_MEANS = """round(avg({c}) filter (where y = 0), 4) as benign_mean,
  round(avg({c}) filter (where y = 1), 4) as attack_mean,
  round(abs(avg({c}) filter (where y = 0) - avg({c}) filter (where y = 1)), 4) as difference"""


@check("p11_class_means", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _MEANS)}")
def class_means(spark, sf_dir):
    return profile.class_means(coded(spark, sf_dir), _NUMERIC)


_RANGE = """round(avg({c}), 4) as mean, round(median(cast({c} as double)), 4) as median,
  round(cast(min({c}) as double), 4) as min, round(cast(max({c}) as double), 4) as max"""


@check("p12_mean_median_range", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _RANGE)}")
def mean_median_range(spark, sf_dir):
    return profile.mean_median_range(flow_table(spark, sf_dir), _NUMERIC)


_CONSTANT = """round(stddev_samp({c}), 4) as std, round(cast(min({c}) as double), 4) as low,
  round(cast(max({c}) as double), 4) as high, min({c}) = max({c}) as is_constant"""


@check("p13_constant_features", f"{WITH_FLOWS} {unpivot_sql('fl', _NUMERIC, _CONSTANT)}")
def constant_features(spark, sf_dir):
    return profile.constant_features(flow_table(spark, sf_dir), _NUMERIC)


@check(
    "p14_distinct_counts",
    f"{WITH_FLOWS} {unpivot_sql('fl', ['protocol', 'src_ip', 'dst_port', 'flow_duration'], 'count(distinct {c}) as distinct_values')}",
)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(
        flow_table(spark, sf_dir), ["protocol", "src_ip", "dst_port", "flow_duration"]
    )


@check(
    "p15_query_type_verdict",
    f"""{WITH_FLOWS} select count(*) as flow_total, count(*) filter (where dns_total_queries > 0) as dns_flows,
     count(*) filter (where dns_any_query_ratio > 0) as any_flows,
     count(*) filter (where dns_txt_query_ratio > 0) as txt_flows,
     round(max(dns_any_query_ratio), 4) as any_max, round(max(dns_txt_query_ratio), 4) as txt_max,
     case when max(dns_any_query_ratio) > 0 or max(dns_txt_query_ratio) > 0 then 'PASSED'
       else 'FAILED' end as verdict from fl""",
)
def query_type_verdict(spark, sf_dir):
    return profile.query_type_verdict(flow_table(spark, sf_dir))


@check(
    "p16_source_comparison",
    f"""{WITH_FLOWS}, c as (select *, greatest(score, 1 - score) as m from fx)
    select capture_id as source, count(*) as total, count(*) filter (where prediction = 0) as benign,
     count(*) filter (where prediction = 1) as attack,
     count(*) filter (where m > 0.9) as high_confidence,
     count(*) filter (where m >= 0.7 and m <= 0.9) as medium_confidence,
     count(*) filter (where m < 0.7) as low_confidence, round(avg(m), 4) as mean_confidence,
     round(count(*) filter (where prediction = 0) * 100.0 / count(*), 4) as benign_percent,
     round(count(*) filter (where prediction = 1) * 100.0 / count(*), 4) as attack_percent
    from c group by capture_id""",
)
def source_comparison(spark, sf_dir):
    rows = coded(spark, sf_dir).withColumn(
        "confidence", F.greatest(F.col("score"), 1 - F.col("score"))
    )
    return profile.compare_sources(rows.withColumnRenamed("capture_id", "source"))


@check(
    "p18_time_range",
    f"""{WITH_FLOWS} select strftime(make_timestamp(min(start_ms) * 1000), '%Y-%m-%d %H:%M:%S') || ' to ' ||
     strftime(make_timestamp(max(start_ms) * 1000), '%Y-%m-%d %H:%M:%S') as timestamp_range
    from fl where flow_no % 10 <> 0""",
)
def time_range(spark, sf_dir):
    text = epoch_ms_to_timestamp(F.col("start_ms")).cast("string")
    broken = F.when(F.col("flow_no") % 10 == 0, "not a time").otherwise(text)
    return profile.time_range(flow_table(spark, sf_dir).withColumn("start_time", broken))


# --- order, samples, unions --------------------------------------------------


@check(
    "w05_label_changes",
    f"""{WITH_FLOWS}, s as (select label, lag(label) over (order by first_seq) as before,
      row_number() over (order by first_seq) as rn from fl)
    select count(*) as row_total, count(*) filter (where rn = 1 or label <> before) as label_changes,
     count(*) filter (where rn = 1 or label <> before) > count(*) * 0.01 as is_shuffled from s""",
)
def label_changes(spark, sf_dir):
    return ordered.changes_in_order(flow_table(spark, sf_dir), "first_seq", "label", span=4096)


@check(
    "w06_first_hundred_labels",
    f"{WITH_FLOWS} select label, count(*) as n from (select * from fl order by first_seq limit 100) group by label",
)
def first_hundred_labels(spark, sf_dir):
    first = sampling.first_rows(flow_table(spark, sf_dir), 100, ["first_seq"])
    return first.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@check(
    "w07_top_middle_bottom",
    f"""{WITH_FLOWS}, o as (select *, row_number() over (order by first_seq) - 1 as rn, count(*) over () as n
      from fl where dns_total_queries > 1 and dns_total_responses > 1),
    w as (select *, unnest(['top', 'middle', 'bottom']) as pick,
      unnest([0, cast(round_even(n / 2.0, 0) as bigint), n - 1]) as pos from o)
    select capture_id, first_seq, pick from w where rn = pos""",
)
def top_middle_bottom(spark, sf_dir):
    rich = prepare.dns_rich(flow_table(spark, sf_dir), above=1)
    return sampling.pick_positions(rich, "first_seq").select(*FLOW_HANDLE, "pick")


_MD5 = "md5(cast(first_seq as varchar) || '|42')"


@check(
    "w07_one_per_third",
    f"""{WITH_FLOWS}, o as (select *, (row_number() over (order by first_seq) - 1) * 3 // count(*) over () as third,
      {_MD5} as h from fl)
    select cast(third as int) as third, arg_min(first_seq, h) as first_seq from o group by third""",
)
def one_per_third(spark, sf_dir):
    picks = sampling.one_per_third(flow_table(spark, sf_dir), "first_seq", ["first_seq"])
    return picks.select("third", "first_seq")


@check(
    "l01_exact_sample",
    f"{WITH_FLOWS} select capture_id, first_seq from fl order by {_MD5} limit 1000",
)
def exact_sample(spark, sf_dir):
    return sampling.exact_sample(flow_table(spark, sf_dir), 1000, ["first_seq"]).select(*FLOW_HANDLE)


@check("l02_sample_or_all", f"{WITH_FLOWS} select capture_id, first_seq from fl")
def sample_or_all(spark, sf_dir):
    flows = flow_table(spark, sf_dir)
    return sampling.exact_sample(flows, 1 << 40, ["first_seq"]).select(*FLOW_HANDLE)


@check(
    "l01_balanced_classes",
    f"""{WITH_FLOWS}, o as (select *, row_number() over (partition by label order by {_MD5}) as rn from fl)
    select capture_id, first_seq, label from o where label = 'BENIGN' or rn <= 300""",
)
def balanced_classes(spark, sf_dir):
    flows = flow_table(spark, sf_dir)
    return sampling.balance_classes(flows, "label", {"ATTACK": 300}, ["first_seq"]).select(
        *FLOW_HANDLE, "label"
    )


@check(
    "l03_full_shuffle",
    f"{WITH_FLOWS} select capture_id, first_seq, label from fl order by {_MD5}",
)
def full_shuffle(spark, sf_dir):
    return sampling.shuffle_rows(flow_table(spark, sf_dir), ["first_seq"]).select(*FLOW_HANDLE, "label")


@check("l04_shuffle_if_sorted", f"{WITH_FLOWS} select capture_id, first_seq, label from fl")
def shuffle_if_sorted(spark, sf_dir):
    flows = flow_table(spark, sf_dir)
    return sampling.shuffle_if_sorted(flows, "first_seq", "label", ["first_seq"]).select(
        *FLOW_HANDLE, "label"
    )


@check(
    "l05_top_values",
    f"""{WITH_FLOWS} select src_ip, count(*) as n, round(count(*) * 100.0 / (select count(*) from fl), 4) as percent
    from fl group by src_ip order by n desc, src_ip limit 10""",
)
def top_values(spark, sf_dir):
    return profile.value_counts(flow_table(spark, sf_dir), "src_ip", top=10)


@check(
    "l06_preview",
    f"{WITH_FLOWS} select {sql_columns([*FLOW_HANDLE, *SOME[:5]])} from fl order by first_seq limit 10",
)
def preview(spark, sf_dir):
    return sampling.first_rows(flow_table(spark, sf_dir), 10, ["first_seq"]).select(
        *FLOW_HANDLE, *SOME[:5]
    )


@check(
    "u01_union_all",
    f"""{WITH_FLOWS} select first_seq, 1 as label, protocol, null::bigint as flow_duration from fl where y = 1
    union all select first_seq, 0, null, flow_duration from fl where y = 0""",
)
def union_all(spark, sf_dir):
    flows = coded(spark, sf_dir)
    attacks = prepare.only_class(flows, 1).select("first_seq", "label", "protocol")
    benign = prepare.only_class(flows, 0).select("first_seq", "label", "flow_duration")
    return prepare.union_all([attacks, benign])


@check(
    "u02_build_dataset",
    f"""{WITH_FLOWS}, o as (select *, row_number() over (partition by y, capture_id order by {_MD5}) as rn from fl)
    select first_seq, y as label, capture_id as source from o
    where y = 0 or capture_id <> 'cap0' or rn <= 200""",
)
def build_dataset(spark, sf_dir):
    flows = flow_table(spark, sf_dir).withColumn("source", F.col("capture_id"))
    attacks, benign = flows.filter("y = 1"), flows.filter("y = 0")
    built = prepare.build_dataset(attacks, benign, ["first_seq"], quotas={"cap0": 200})
    return built.select("first_seq", "label", "source")


@check(
    "u02_dataset_statistics",
    f"""{WITH_FLOWS}, c as (select count(*) filter (where y = 0) as benign, count(*) filter (where y = 1) as attack from fl)
    select benign, attack, round(attack / cast(benign as double), 4) as attack_per_benign,
     abs(benign - attack) < 100 as is_balanced, benign + attack as total,
     round(benign * 100.0 / (benign + attack), 4) as benign_percent from c""",
)
def dataset_statistics(spark, sf_dir):
    return prepare.dataset_statistics(coded(spark, sf_dir))


# --- repair ------------------------------------------------------------------

# Every third line is right, every third has a trailing comma, the others an
# extra first field; some lines are cut off or repeat the header.
_HEADER = ",".join(FLOW_COLUMNS)


def _export(spark, sf_dir):
    lines = flow_table(spark, sf_dir).select(
        "first_seq", F.concat_ws(",", *sinks.export_columns(False)).alias("line")
    )
    seq, line = F.col("first_seq"), F.col("line")
    value = (
        F.when(seq % 50 == 0, F.lit(_HEADER))
        .when(seq % 50 == 1, F.substring_index(line, ",", 20))
        .when(seq % 3 == 0, line)
        .when(seq % 3 == 1, F.concat(line, F.lit(",")))
        .otherwise(F.concat(seq.cast("string"), F.lit(","), line))
    )
    return lines.select("first_seq", value.alias("value"))


_STATUS = """case when first_seq % 50 = 0 then 'header' when first_seq % 50 = 1 then 'malformed'
  when first_seq % 3 = 0 then 'ok' when first_seq % 3 = 1 then 'trailing' else 'indexed' end"""


@check(
    "r01_drop_malformed",
    f"""{WITH_FLOWS}, s as (select *, {_STATUS} as st from fl)
    select first_seq from s where st in ('ok', 'header')""",
)
def drop_malformed(spark, sf_dir):
    return repair.drop_malformed(_export(spark, sf_dir)).select("first_seq")


@check(
    "r02_repaired_lines",
    f"""{WITH_FLOWS}, s as (select *, {_STATUS} as repair from fl)
    select repair, {sql_columns(["src_ip", "dst_ip", "src_port", "dst_port", "protocol", *SOME, "average_packet_size"])}
    from s where repair in ('ok', 'trailing', 'indexed')""",
)
def repaired_lines(spark, sf_dir):
    rows = repair.repair_lines(_export(spark, sf_dir))
    return rows.select("repair", *FLOW_COLUMNS[:5], *SOME, "average_packet_size")


@check(
    "r02_repair_summary",
    f"{WITH_FLOWS} select {_STATUS} as status, count(*) as line_total from fl group by 1",
)
def repair_summary(spark, sf_dir):
    return repair.repair_summary(_export(spark, sf_dir))


@check(
    "r03_shift_check",
    f"""{WITH_FLOWS} select count(*) as row_total, count(*) as integer_dst_ip, count(*) as numeric_protocol,
     count(*) as foreign_protocol, true as names_as_expected, true as is_shifted from fl""",
)
def shift_check(spark, sf_dir):
    flows = flow_table(spark, sf_dir).select(*FLOW_COLUMNS)
    text = [F.col(c).cast("string") for c in FLOW_COLUMNS]
    shifted = flows.select(*[t.alias(n) for t, n in zip(text[1:] + text[:1], FLOW_COLUMNS)])
    return repair.shift_check(shifted)


@check("r03_undo_shift", f"{WITH_FLOWS} select src_ip, dst_ip, src_port, dst_port, protocol, flow_duration from fl")
def undo_shift(spark, sf_dir):
    flows = flow_table(spark, sf_dir).select(*FLOW_COLUMNS)
    names = ["index", *FLOW_COLUMNS[:-1]]
    shifted = flows.select(*[F.col(c).alias(n) for c, n in zip(FLOW_COLUMNS, names)])
    return repair.rename_by_position(shifted).select(*IDENTITY_COLUMNS, "protocol", "flow_duration")


@check(
    "r04_legacy_names",
    f"""{WITH_FLOWS} select src_ip, flow_duration, total_fwd_packets, {r4("average_packet_size")},
     dns_response_bytes from fl""",
)
def legacy_names(spark, sf_dir):
    old = repair.to_legacy_names(flow_table(spark, sf_dir).select(*FLOW_COLUMNS))
    flows = repair.from_legacy_names(old)
    return flows.select(
        "src_ip", "flow_duration", "total_fwd_packets", "average_packet_size", "dns_response_bytes"
    )
