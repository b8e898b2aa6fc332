"""Checked queries on audits, models, evaluation, reports and streams."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowchecks.base import (
    FLOW_HANDLE,
    WITH_FLOWS,
    WITH_VALID,
    check,
    coded,
    flow_table,
    packets,
    r4,
    sql_columns,
    unpivot_sql,
)
from flowloom.functions.columns import epoch_ms_to_timestamp
from flowloom.operators import audit, evaluate, learn, profile, report, sampling
from flowloom.plans.flow_tables import detect, scratch_folder, stored, trained_model
from flowloom.schemas import FEATURE_COLUMNS, FLOW_FIELDS
from flowloom.sources import sinks
from flowloom.sources.events import packets_from_events
from flowloom.streaming import late, run
from flowloom.streaming.sessions import session_flows
from flowloom.streaming.stateful import arrival_order_flows

# --- audit -------------------------------------------------------------------

_TRUTH = f"""{WITH_FLOWS}, tp as (
 select f.first_seq as flow_id, p.ts_ms, p.len, p.is_dns, p.dns_qr, p.dns_ancount,
  p.s = f.src_ip || ':' || f.src_port as fwd,
  p.ts_ms - lag(p.ts_ms) over (partition by f.first_seq order by p.ts_ms, p.seq) as gap
 from fl f join vp p on p.capture_id = f.capture_id and p.lo = f.lo and p.hi = f.hi
  and p.protocol = f.protocol and p.ts_ms between f.start_ms and f.end_ms),
tg as (
 select flow_id, count(*) as n, count(*) filter (where fwd) as fwd_packets,
  count(*) filter (where not fwd) as bwd_packets,
  cast(coalesce(sum(len) filter (where fwd), 0) as bigint) as fwd_bytes,
  cast(coalesce(sum(len) filter (where not fwd), 0) as bigint) as bwd_bytes,
  max(ts_ms) - min(ts_ms) as duration_ms, cast(min(len) as double) as len_min,
  cast(max(len) as double) as len_max, avg(len) as len_mean, stddev_pop(len) as len_std_pop,
  cast(min(gap) as double) as iat_min, cast(max(gap) as double) as iat_max, avg(gap) as iat_mean,
  count(*) filter (where is_dns and not dns_qr) as queries,
  count(*) filter (where is_dns and dns_qr) as responses,
  avg(len) filter (where is_dns and not dns_qr) as mean_query,
  avg(len) filter (where is_dns and dns_qr) as mean_response,
  count(*) filter (where is_dns and not dns_qr and fwd) as fwd_queries,
  count(*) filter (where is_dns and dns_qr and not fwd) as bwd_responses,
  cast(coalesce(sum(len) filter (where is_dns and not dns_qr and fwd), 0) as bigint) as fwd_query_bytes,
  cast(coalesce(sum(len) filter (where is_dns and dns_qr and not fwd), 0) as bigint) as bwd_response_bytes,
  cast(coalesce(sum(dns_ancount) filter (where is_dns and dns_qr and not fwd), 0) as bigint) as bwd_answers
 from tp group by flow_id),
tt as (select *,
  case when coalesce(mean_query, 0) > 0 then coalesce(mean_response, 0) / mean_query else 0.0 end
    as mean_size_ratio,
  case when responses > 0 then queries / cast(responses as double) else cast(queries as double) end
    as query_ratio from tg)"""

_TRUTH_NAMES = [
    "n",
    "fwd_packets",
    "bwd_packets",
    "fwd_bytes",
    "bwd_bytes",
    "duration_ms",
    "queries",
    "responses",
    "fwd_queries",
    "bwd_responses",
    "fwd_query_bytes",
    "bwd_response_bytes",
    "bwd_answers",
]
_TRUTH_DOUBLES = [
    "len_min",
    "len_max",
    "len_mean",
    "len_std_pop",
    "iat_min",
    "iat_max",
    "iat_mean",
    "mean_size_ratio",
    "query_ratio",
]


@check(
    "j01_flow_truth",
    f"""{_TRUTH} select flow_id, {', '.join(_TRUTH_NAMES)}, {', '.join(r4(c) for c in _TRUTH_DOUBLES)} from tt""",
)
def flow_truth(spark, sf_dir):
    truth = audit.flow_truth(flow_table(spark, sf_dir), packets(spark, sf_dir), "first_seq")
    return truth.select("flow_id", *_TRUTH_NAMES, *_TRUTH_DOUBLES)


_NUMERIC = [c for c in FEATURE_COLUMNS if c != "protocol"]


@check(
    "j03_baseline_difference",
    f"{WITH_FLOWS} "
    + unpivot_sql(
        "fl",
        _NUMERIC,
        """round(avg({c}) filter (where y = 0), 4) as baseline_mean,
  round(avg({c}) filter (where capture_id = 'cap1'), 4) as test_mean,
  round(abs(avg({c}) filter (where y = 0) - avg({c}) filter (where capture_id = 'cap1')), 4) as difference""",
    ),
)
def baseline_difference(spark, sf_dir):
    flows = coded(spark, sf_dir)
    baseline = profile.baseline_means(flows.filter("label = 0"), _NUMERIC)
    return profile.compare_with_baseline(flows.filter("capture_id = 'cap1'"), baseline, _NUMERIC)


def _audited_flows(spark, sf_dir):
    """The flow table with known mistakes in some rows, so that checks also fail."""
    wrong = F.col("first_seq") % 10 == 0
    flows = flow_table(spark, sf_dir)
    return flows.withColumns(
        {
            "total_fwd_packets": F.col("total_fwd_packets") + F.when(wrong, 1).otherwise(0),
            "average_packet_size": F.col("average_packet_size") + F.when(wrong, 0.75).otherwise(0.0),
            "dns_total_queries": F.col("dns_total_queries") + F.when(wrong, 2).otherwise(0),
        }
    )


_WRONG = """, af as (select * replace (
  total_fwd_packets + case when first_seq % 10 = 0 then 1 else 0 end as total_fwd_packets,
  average_packet_size + case when first_seq % 10 = 0 then 0.75 else 0 end as average_packet_size,
  dns_total_queries + case when first_seq % 10 = 0 then 2 else 0 end as dns_total_queries) from fl),
au as (select af.*, tt.* exclude (flow_id), tt.flow_id is not null as matched,
  coalesce(tt.fwd_packets, 0) as xfp, coalesce(tt.bwd_packets, 0) as xbp,
  coalesce(tt.fwd_bytes, 0) as xfb, coalesce(tt.bwd_bytes, 0) as xbb,
  coalesce(tt.fwd_queries, 0) as xq, coalesce(tt.bwd_responses, 0) as xr,
  dns_total_queries > 0 or dns_total_responses > 0 as has_dns
  from af left join tt on tt.flow_id = af.first_seq)"""


def _audit_rows(checks) -> str:
    """``(column, tool, truth, passes, applies, failed)`` to united report rows."""
    rows = []
    for column, tool, truth, passes, applies, failed in checks:
        rows.append(
            f"""select first_seq as flow_id, '{column}' as column_name,
            round(cast({tool} as double), 4) as tool, round(cast({truth} as double), 4) as truth,
            case when coalesce({passes}, false) then 'PASS' else '{failed}' end as status
            from au where coalesce({applies}, false)"""
        )
    return _TRUTH + _WRONG + " " + " union all ".join(rows)


_LOOSE = {
    "flow_duration": ("duration_ms", "<= 5", "< 1000"),
    "total_fwd_packets": ("fwd_packets", "<= 0", None),
    "total_bwd_packets": ("bwd_packets", "<= 0", None),
    "average_packet_size": ("len_mean", "<= 1", "< 1"),
    "packet_size_std": ("len_std_pop", "<= 1", "< 2"),
    "dns_total_queries": ("queries", "<= 0", None),
    "dns_total_responses": ("responses", "<= 0", None),
    "dns_amplification_factor": ("mean_size_ratio", "<= 0.2", None),
    "query_response_ratio": ("query_ratio", "<= 0.2", None),
}


def _loose_pass(column, truth, first, second):
    text = f"abs({column} - {truth}) {first}"
    return f"({text} or abs({column} - {truth}) {second})" if second else text


_LOOSE_SQL = _audit_rows(
    (c, c, t, _loose_pass(c, t, a, b), "true", "DIFF") for c, (t, a, b) in _LOOSE.items()
)


@check("v01_loose_audit", _LOOSE_SQL)
def loose_audit(spark, sf_dir):
    return audit.loose_audit(_audited_flows(spark, sf_dir), packets(spark, sf_dir), "first_seq")


_SECS = "(case when flow_duration > 0 then flow_duration / 1000.0 else 1.0 end)"


def _near(column, truth, bound):
    return (column, column, truth, f"abs({column} - ({truth})) {bound}")


_STRICT = [
    (*_near("total_fwd_packets", "xfp", "= 0"), "true"),
    (*_near("total_bwd_packets", "xbp", "= 0"), "true"),
    (*_near("total_fwd_bytes", "xfb", "<= 1"), "true"),
    (*_near("total_bwd_bytes", "xbb", "<= 1"), "true"),
    (*_near("flow_duration", "duration_ms", "< 10"), "matched"),
    (*_near("flow_length_min", "len_min", "= 0"), "matched"),
    (*_near("flow_length_max", "len_max", "= 0"), "matched"),
    (*_near("average_packet_size", "len_mean", "< 0.5"), "matched"),
    (*_near("flow_iat_min", "iat_min", "< 1"), "n > 1"),
    (*_near("flow_iat_max", "iat_max", "< 1"), "n > 1"),
    (*_near("flow_iat_mean", "iat_mean", "< 1"), "n > 1"),
    (*_near("fwd_packet_length_mean", "case when xfp > 0 then xfb / cast(xfp as double) else 0 end", "< 0.5"), "true"),
    (*_near("bwd_packet_length_mean", "case when xbp > 0 then xbb / cast(xbp as double) else 0 end", "< 0.5"), "true"),
    (*_near("flow_bytes_per_sec", f"(xfb + xbb) / {_SECS}", "< 1"), "true"),
    (*_near("flow_packets_per_sec", f"(xfp + xbp) / {_SECS}", "< 0.1"), "true"),
    (*_near("fwd_packets_per_sec", f"xfp / {_SECS}", "< 0.1"), "true"),
    (*_near("bwd_packets_per_sec", f"xbp / {_SECS}", "< 0.1"), "true"),
    (*_near("dns_total_queries", "xq", "= 0"), "has_dns"),
    (*_near("dns_total_responses", "xr", "= 0"), "has_dns"),
    (*_near("dns_amplification_factor", "case when fwd_query_bytes > 0 then bwd_response_bytes / cast(fwd_query_bytes as double) else 0 end", "< 0.01"), "has_dns and xq > 0"),
    (*_near("dns_mean_answers_per_query", "case when xr > 0 then bwd_answers / cast(xr as double) else 0 end", "< 0.01"), "has_dns and xr > 0"),
    (*_near("dns_queries_per_second", f"xq / {_SECS}", "< 0.01"), "has_dns"),
    (*_near("query_response_ratio", "case when dns_total_responses > 0 then dns_total_queries / cast(dns_total_responses as double) else dns_total_queries end", "< 0.01"), "has_dns"),
    ("packet_size_std", "packet_size_std", "null", "packet_size_std >= 0", "matched"),
    ("flow_iat_std", "flow_iat_std", "null", "flow_iat_std >= 0", "n > 1"),
    ("fwd_iat_mean", "fwd_iat_mean", "null", "fwd_iat_mean >= 0", "true"),
    ("bwd_iat_mean", "bwd_iat_mean", "null", "bwd_iat_mean >= 0", "true"),
    ("label", "null", "null", "label in ('ATTACK', 'BENIGN')", "true"),
]
_STRICT_SQL = _audit_rows((*c, "FAIL") for c in _STRICT)


@check("v02_strict_audit", _STRICT_SQL)
def strict_audit(spark, sf_dir):
    return audit.strict_audit(_audited_flows(spark, sf_dir), packets(spark, sf_dir), "first_seq")


@check(
    "v03_audit_summary",
    f"""with report as ({_STRICT_SQL})
    select flow_id, count(*) filter (where status = 'PASS') as passed,
     count(*) filter (where status <> 'PASS') as failed, count(*) as checks,
     cast(grouping(flow_id) as int) as is_total,
     round(count(*) filter (where status = 'PASS') * 100.0 / count(*), 4) as pass_rate
    from report group by rollup (flow_id)""",
)
def audit_summary(spark, sf_dir):
    flows, frames = _audited_flows(spark, sf_dir), packets(spark, sf_dir)
    return audit.audit_summary(audit.strict_audit(flows, frames, "first_seq"))


@check(
    "v03_column_summary",
    f"""with report as ({_STRICT_SQL})
    select column_name, count(*) filter (where status = 'PASS') as passed, count(*) as checks,
     round(count(*) filter (where status = 'PASS') * 100.0 / count(*), 4) as pass_rate
    from report group by column_name""",
)
def column_summary(spark, sf_dir):
    flows, frames = _audited_flows(spark, sf_dir), packets(spark, sf_dir)
    return audit.column_summary(audit.strict_audit(flows, frames, "first_seq"))


_SHORT = [
    ("total_packets", "total_fwd_packets + total_bwd_packets", "coalesce(n, 0)", "= 0"),
    ("duration", "flow_duration / 1000.0", "coalesce(duration_ms / 1000.0, 0)", "< 0.001"),
    ("dns_total_queries", "dns_total_queries", "coalesce(queries, 0)", "= 0"),
    ("dns_total_responses", "dns_total_responses", "coalesce(responses, 0)", "= 0"),
    ("total_bytes", "total_fwd_bytes + total_bwd_bytes", "xfb + xbb", "= 0"),
]


@check(
    "v04_short_audit",
    _audit_rows(
        (c, tool, truth, f"abs(({tool}) - ({truth})) {bound}", "protocol = 'UDP'", "FAIL")
        for c, tool, truth, bound in _SHORT
    ),
)
def short_audit(spark, sf_dir):
    return audit.short_audit(_audited_flows(spark, sf_dir), packets(spark, sf_dir), "first_seq")


# --- features and models -----------------------------------------------------


def _encoded(spark, sf_dir, **options):
    flows = coded(spark, sf_dir)
    ready = learn.prepare_features(flows, keep=FLOW_HANDLE)
    return Pipeline(stages=learn.feature_stages(**options)).fit(ready).transform(ready)


@check(
    "m01_protocol_index",
    f"{WITH_FLOWS} select capture_id, first_seq, round(case protocol when 'TCP' then 0.0 else 1.0 end::double, 4) as protocol_index from fl",
)
def protocol_index(spark, sf_dir):
    return _encoded(spark, sf_dir).select(*FLOW_HANDLE, "protocol_index")


@check(
    "m02_feature_vectors",
    f"{WITH_FLOWS} select capture_id, first_seq, 36 as features, {r4('average_packet_size', 'last_value')} from fl",
)
def feature_vectors(spark, sf_dir):
    values = vector_to_array("features")
    return _encoded(spark, sf_dir).select(
        *FLOW_HANDLE, F.size(values).alias("features"), F.element_at(values, -1).alias("last_value")
    )


@check(
    "m03_one_hot",
    f"""{_TRUTH.split(', tp as')[0]}, d as (select capture_id, lo, hi, protocol, flow_no, min(seq) as first_seq,
      coalesce(arg_max(dns_opcode, seq) filter (where is_dns), 0) as op from pa group by all)
    select capture_id, first_seq, round(case when op = 0 then 1.0 else 0.0 end::double, 4) as is_query_opcode from d""",
)
def one_hot(spark, sf_dir):
    from pyspark.ml.feature import OneHotEncoder

    from flowloom.operators.flow_features import flow_features

    flows = flow_features(
        packets(spark, sf_dir), keep=("capture_id", "first_seq", "dns_opcode"), groups=("dns_detail",)
    )
    encoder = OneHotEncoder(inputCol="dns_opcode", outputCol="opcode_vector", handleInvalid="keep")
    wide = encoder.fit(flows).transform(flows)
    return wide.select(*FLOW_HANDLE, vector_to_array("opcode_vector")[0].alias("is_query_opcode"))


@check(
    "m04_standard_scaling",
    f"""{WITH_FLOWS}, m as (select avg(average_packet_size) as a, stddev_samp(average_packet_size) as s from fl)
    select capture_id, first_seq, {r4("(average_packet_size - a) / s", "scaled")} from fl, m""",
)
def standard_scaling(spark, sf_dir):
    values = vector_to_array("features")
    rows = _encoded(spark, sf_dir, scaling="standard")
    return rows.select(*FLOW_HANDLE, F.element_at(values, -1).alias("scaled"))


@check(
    "m05_min_max_features",
    f"""{WITH_FLOWS}, m as (select min(average_packet_size) as a, max(average_packet_size) as b from fl)
    select capture_id, first_seq, {r4("(average_packet_size - a) / (b - a)", "scaled")} from fl, m""",
)
def min_max_features(spark, sf_dir):
    values = vector_to_array("features")
    rows = _encoded(spark, sf_dir, scaling="minmax")
    return rows.select(*FLOW_HANDLE, F.element_at(values, -1).alias("scaled"))


_SPLIT = """{w}, o as (select *, row_number() over (partition by y order by
   md5(cast(first_seq as varchar) || '|42')) as rn, count(*) over (partition by y) as c from fl)
 select capture_id, first_seq, y as label,
  case when rn <= round(c * {f}) then 'test' else 'train' end as split from o"""


@check("m06_stratified_split_20", _SPLIT.format(w=WITH_FLOWS, f="0.2"))
def stratified_split(spark, sf_dir):
    rows = sampling.stratified_split(coded(spark, sf_dir), 0.2, ["first_seq"])
    return rows.select(*FLOW_HANDLE, "label", "split")


@check("m06_stratified_split_30", _SPLIT.format(w=WITH_FLOWS, f="0.3"))
def stratified_split_30(spark, sf_dir):
    rows = sampling.stratified_split(coded(spark, sf_dir), 0.3, ["first_seq"])
    return rows.select(*FLOW_HANDLE, "label", "split")


@check(
    "m06_hash_split",
    f"""{WITH_FLOWS} select capture_id, first_seq, case when
     cast('0x' || left(md5(cast(first_seq as varchar) || '|42'), 5) as bigint) < 209715
     then 'test' else 'train' end as split from fl""",
)
def hash_split(spark, sf_dir):
    return sampling.hash_split(coded(spark, sf_dir), 0.2, ["first_seq"]).select(*FLOW_HANDLE, "split")


_MODELS: dict = {}


def _model(spark, sf_dir, kind):
    """A model with the settings of the library, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MODELS:
        split = sampling.hash_split(coded(spark, sf_dir), 0.2, ["first_seq"])
        _MODELS[key] = learn.fit(split.filter("split = 'train'"), kind)
    return _MODELS[key]


def _scored(spark, sf_dir, kind):
    return learn.score(_model(spark, sf_dir, kind), coded(spark, sf_dir).drop("score", "prediction"))


# A fitted model cannot be stated in SQL; what must hold for every one can.
_IN_RANGE = "score between 0.0 and 1.0"
_CONSISTENT = "(score > 0.5) = (prediction = 1)"


def _fitted_facts(model, scored, trees=None):
    last = model.stages[-1]
    return scored.agg(
        F.count(F.lit(1)).alias("row_total"),
        F.count_if(F.expr(_IN_RANGE)).alias("in_range"),
        F.count_if(F.expr(_CONSISTENT)).alias("consistent"),
    ).select(
        "*",
        F.lit(last.getNumTrees if trees is None else trees).alias("trees"),
        F.lit(last.getOrDefault("maxDepth")).alias("max_depth"),
    )


_FACTS = """{w} select count(*) as row_total, count(*) as in_range, count(*) as consistent,
 {trees} as trees, {depth} as max_depth from fl"""


@check("m07_boosted_deep", _FACTS.format(w=WITH_FLOWS, trees=200, depth=8))
def boosted_deep(spark, sf_dir):
    return _fitted_facts(_model(spark, sf_dir, "boosted_deep"), _scored(spark, sf_dir, "boosted_deep"))


@check("m08_random_forest", _FACTS.format(w=WITH_FLOWS, trees=100, depth=20))
def random_forest(spark, sf_dir):
    return _fitted_facts(_model(spark, sf_dir, "forest"), _scored(spark, sf_dir, "forest"))


@check("m09_boosted_early_stop", _FACTS.format(w=WITH_FLOWS, trees="true", depth=5))
def boosted_early_stop(spark, sf_dir):
    """``trees``: whether boosting stopped before its last round."""
    flows = sampling.hash_split(coded(spark, sf_dir), 0.3, ["first_seq"])
    flows = flows.withColumn("held_out", F.col("split") == "test")
    model = learn.fit(flows, "boosted_leafy", validation="held_out")
    scored = learn.score(model, flows.drop("score", "prediction"))
    return _fitted_facts(model, scored, model.stages[-1].getNumTrees < learn.BOOSTED_LEAFY["maxIter"])


@check(
    "m10_stratified_folds",
    f"""{WITH_FLOWS} select capture_id, first_seq, y as label, cast((row_number() over (partition by y
     order by md5(cast(first_seq as varchar) || '|42')) - 1) % 5 as int) as fold from fl""",
)
def stratified_folds(spark, sf_dir):
    rows = sampling.stratified_folds(coded(spark, sf_dir), 5, ["first_seq"])
    return rows.select(*FLOW_HANDLE, "label", "fold")


@check(
    "m10_cross_validation",
    f"""{WITH_FLOWS}, o as (select y, (row_number() over (partition by y
     order by md5(cast(first_seq as varchar) || '|42')) - 1) % 5 as fold from fl)
    select cast(fold as int) as fold, count(*) as row_total, true as in_range from o group by 1""",
)
def cross_validation(spark, sf_dir):
    scores = learn.cross_validate(coded(spark, sf_dir), "forest", ["first_seq"])
    return scores.select("fold", "row_total", F.col("accuracy").between(0.0, 1.0).alias("in_range"))


@check(
    "m11_training_curve",
    """select cast(unnest(range(1, 201)) as int) as round, true as is_positive, true as not_above_start""",
)
def training_curve(spark, sf_dir):
    split = sampling.hash_split(coded(spark, sf_dir), 0.2, ["first_seq"])
    losses = learn.training_curve(_model(spark, sf_dir, "boosted_deep"), split.filter("split = 'train'"))
    rows = [(i + 1, float(v) > 0, float(v) <= float(losses[0])) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "round int, is_positive boolean, not_above_start boolean")


@check(
    "m12_importances",
    "select cast(36 as bigint) as features, cast(36 as bigint) as ranks, 36 as last_rank, round(1.0::double, 4) as total",
)
def importances(spark, sf_dir):
    return learn.importances(_model(spark, sf_dir, "forest"), spark).agg(
        F.count_distinct("feature").alias("features"),
        F.count_distinct("rank").alias("ranks"),
        F.max("rank").alias("last_rank"),
        F.sum("importance").alias("total"),
    )


@check(
    "m13_probabilities",
    f"{WITH_FLOWS} select capture_id, first_seq, true as in_range, true as consistent from fl",
)
def probabilities(spark, sf_dir):
    rows = _scored(spark, sf_dir, "forest")
    return rows.select(*FLOW_HANDLE, F.expr(_IN_RANGE).alias("in_range"), F.expr(_CONSISTENT).alias("consistent"))


# The labels of the tables do not follow from the features. Here they do, by a rule of two
# features, so a fit that learned nothing fails these queries. Smaller settings do.
_RULE_SETTINGS = {
    "boosted_deep": {"maxIter": 20},
    "forest": {"numTrees": 20, "maxDepth": 8},
    "boosted_leafy": {"maxIter": 20},
}


def _ruled(spark, sf_dir):
    flows = coded(spark, sf_dir).drop("score", "prediction")
    middle = flows.agg(F.percentile_approx("flow_length_max", 0.5)).first()[0]
    rule = (F.col("flow_length_max") > middle) != (F.col("dns_total_queries") > 0)
    return sampling.hash_split(flows.withColumn("label", rule.cast("int")), 0.3, ["first_seq"])


def _rule_model(spark, sf_dir, kind):
    key = (spark.sparkContext.applicationId, sf_dir, kind, "rule")
    if key not in _MODELS:
        _MODELS[key] = learn.fit(_ruled(spark, sf_dir).filter("split = 'train'"), kind, **_RULE_SETTINGS[kind])
    return _MODELS[key]


def _learned(spark, sf_dir, kind):
    """Whether held-out rows are told apart far better than by the larger class, and the scores too."""
    flows = _ruled(spark, sf_dir)
    scored = learn.score(_rule_model(spark, sf_dir, kind), flows.filter("split = 'test'"))
    right = F.avg((F.col("prediction") == F.col("label")).cast("int"))
    share = F.avg("label")
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("score")))
    facts = scored.agg(
        (right >= F.greatest(share, 1 - share) + 0.1).alias("beats_larger_class"),
        (mean(1) - mean(0) >= 0.3).alias("scores_apart"),
    )
    return facts.crossJoin(flows.agg(F.count(F.lit(1)).alias("row_total")))


_LEARNED = f"{WITH_FLOWS} select count(*) as row_total, true as beats_larger_class, true as scores_apart from fl"


@check("m07_learns_a_rule", _LEARNED)
def boosted_deep_learns(spark, sf_dir):
    return _learned(spark, sf_dir, "boosted_deep")


@check("m08_learns_a_rule", _LEARNED)
def forest_learns(spark, sf_dir):
    return _learned(spark, sf_dir, "forest")


@check("m09_learns_a_rule", _LEARNED)
def boosted_leafy_learns(spark, sf_dir):
    return _learned(spark, sf_dir, "boosted_leafy")


@check(
    "m10_folds_learn_a_rule",
    f"""{WITH_FLOWS} select cast(fold as int) as fold, true as beats_larger_class, count(*) > 0 as has_rows
    from fl, range(5) t(fold) group by fold""",
)
def folds_learn(spark, sf_dir):
    flows = _ruled(spark, sf_dir).drop("split")
    share = flows.agg(F.avg("label")).first()[0]
    scores = learn.cross_validate(flows, "forest", ["first_seq"], **_RULE_SETTINGS["forest"])
    beats = F.col("accuracy") >= max(share, 1 - share) + 0.1
    return scores.select("fold", beats.alias("beats_larger_class"), (F.col("row_total") > 0).alias("has_rows"))


@check("m11_loss_falls", f"{WITH_FLOWS} select count(*) as row_total, 20 as rounds, true as is_halved from fl")
def loss_falls(spark, sf_dir):
    flows = _ruled(spark, sf_dir)
    losses = learn.training_curve(_rule_model(spark, sf_dir, "boosted_deep"), flows.filter("split = 'train'"))
    halved = F.lit(float(losses[len(losses) - 1]) <= 0.5 * float(losses[0]))
    return flows.agg(F.count(F.lit(1)).alias("row_total")).withColumns({"rounds": F.lit(len(losses)), "is_halved": halved})


@check(
    "m12_importances_follow_a_rule",
    f"{WITH_FLOWS} select count(*) as row_total, true as several_count, true as rule_leads from fl",
)
def importances_follow(spark, sf_dir):
    """More than one feature counts, and packet lengths or queries, which the rule is of, lead."""
    flows = _ruled(spark, sf_dir)
    found = learn.importances(_rule_model(spark, sf_dir, "forest"), spark)
    leads = F.max_by("feature", "importance").rlike("length|packet|dns|bytes|quer")
    facts = found.agg((F.count_if(F.col("importance") > 0) > 1).alias("several_count"), leads.alias("rule_leads"))
    return facts.crossJoin(flows.agg(F.count(F.lit(1)).alias("row_total")))


@check(
    "m14_thresholds",
    f"""{WITH_FLOWS} select capture_id, first_seq, case when score >= 0.3 then 1 else 0 end as low,
     case when score >= 0.5 then 1 else 0 end as middle, case when score >= 0.7 then 1 else 0 end as high from fl""",
)
def thresholds(spark, sf_dir):
    score = F.col("score")
    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        report.threshold_prediction(score, 0.3).alias("low"),
        report.threshold_prediction(score).alias("middle"),
        report.threshold_prediction(score, 0.7).alias("high"),
    )


@check(
    "m15_prediction_table",
    f"""{WITH_FLOWS} select capture_id, first_seq, prediction,
     case when prediction = 0 then 'BENIGN' else 'ATTACK' end as prediction_label,
     {r4("1 - score", "confidence_benign")}, {r4("score", "confidence_attack")},
     {r4("greatest(score, 1 - score)", "confidence")}, y as actual, label as actual_label,
     prediction = y as correct from fx""",
)
def prediction_table(spark, sf_dir):
    flows = flow_table(spark, sf_dir)
    return report.prediction_table(flows, actual="y", keep=FLOW_HANDLE)


@check(
    "m15_accuracy",
    f"{WITH_FLOWS} select round(avg(case when prediction = y then 1.0 else 0.0 end), 4) as accuracy from fx",
)
def accuracy(spark, sf_dir):
    return report.accuracy(report.prediction_table(flow_table(spark, sf_dir), actual="y"))


_SHOWN = [c for c, _ in FLOW_FIELDS if c not in ("ttl_violation_rate", "dns_server_fanout")]
_REPORT = f"""select capture_id, first_seq, {sql_columns(_SHOWN)}, label, (select
  strftime(make_timestamp(min(start_ms) * 1000), '%Y-%m-%d %H:%M:%S') || ' to ' ||
  strftime(make_timestamp(max(start_ms) * 1000), '%Y-%m-%d %H:%M:%S') from fl) as timestamp_range,
  prediction, case when prediction = 0 then 'BENIGN' else 'ATTACK' end as prediction_label,
  {r4("1 - score", "confidence_benign")}, {r4("score", "confidence_attack")},
  {r4("greatest(score, 1 - score)", "confidence_score")},
  case when greatest(score, 1 - score) >= 0.9 then 'CRITICAL' when greatest(score, 1 - score) >= 0.8
    then 'HIGH' when greatest(score, 1 - score) >= 0.6 then 'MEDIUM' else 'LOW' end as risk_level
 from fx"""


@check("m16_detection_report", f"{WITH_FLOWS} {_REPORT}")
def detection_report(spark, sf_dir):
    start = epoch_ms_to_timestamp(F.col("start_ms"))
    flows = flow_table(spark, sf_dir).withColumn("start_time", start)
    made = report.detection_report(flows)
    return made.drop("start_time", "flow_no", "start_ms", "end_ms", "u", "y")


@check(
    "p17_risk_distribution",
    f"""{WITH_FLOWS}, r as ({_REPORT}),
    l as (select unnest([0, 1, 2, 3]) as position, unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) as risk_level)
    select cast(l.position as int) as position, l.risk_level, count(r.risk_level) as n,
     round(count(r.risk_level) * 100.0 / (select count(*) from r), 4) as percent
    from l left join r using (risk_level) group by 1, 2""",
)
def risk_distribution(spark, sf_dir):
    return profile.risk_distribution(report.detection_report(flow_table(spark, sf_dir)))


@check(
    "s11_saved_model",
    f"{WITH_FLOWS} select count(*) as row_total, cast(0 as bigint) as different, cast(36 as bigint) as features, 100 as trees from fl",
)
def saved_model(spark, sf_dir):
    """Rows that the saved and the unsaved model score differently, and what was saved."""
    folder = scratch_folder(spark, "model")
    learn.save_model(_model(spark, sf_dir, "forest"), folder, spark)
    rows = coded(spark, sf_dir).drop("score", "prediction")
    again = learn.score(learn.load_model(folder), rows).select(*FLOW_HANDLE, "score", "prediction")
    before = _scored(spark, sf_dir, "forest").select(*FLOW_HANDLE, "score", "prediction")
    kept = spark.read.parquet(f"{folder}/features")
    return again.agg(F.count(F.lit(1)).alias("row_total")).select(
        "row_total",
        before.exceptAll(again).agg(F.count(F.lit(1))).scalar().alias("different"),
        kept.agg(F.count_distinct("feature")).scalar().alias("features"),
        kept.agg(F.max("trees")).scalar().alias("trees"),
    )


@check(
    "plan_train_and_test",
    f"""{WITH_FLOWS}, c as (select y, cast(round(count(*) * 0.2) as bigint) as n from fl group by y)
    select 'test' as test_name, cast(sum(n) as bigint) as row_total, cast(sum(n) filter (where y = 1) as bigint) as positives,
     cast(sum(n) filter (where y = 0) as bigint) as negatives, true as in_range from c""",
)
def train_and_test(spark, sf_dir):
    flows = flow_table(spark, sf_dir).withColumn("source", F.col("capture_id")).drop("score", "label")
    _, metrics = trained_model(
        flows.filter("y = 1"), flows.filter("y = 0"), ["first_seq"], kind="forest", quotas={"cap0": 1 << 40}
    )
    return metrics.select(
        "test_name",
        "row_total",
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("tn") + F.col("fp")).alias("negatives"),
        F.col("accuracy").between(0.0, 1.0).alias("in_range"),
    )


@check(
    "plan_detect",
    f"{WITH_FLOWS} select count(*) as row_total, count(*) as in_band, count(*) as named from fl",
)
def detect_with_model(spark, sf_dir):
    """Rows whose risk level and label text fit their confidence and class."""
    rows = detect(_model(spark, sf_dir, "forest"), flow_table(spark, sf_dir).drop("score"))
    sure = F.col("confidence_score")
    level = F.when(sure >= 0.9, "CRITICAL").when(sure >= 0.8, "HIGH").when(sure >= 0.6, "MEDIUM").otherwise("LOW")
    name = F.when(F.col("prediction") == 1, "ATTACK").otherwise("BENIGN")
    return rows.agg(
        F.count(F.lit(1)).alias("row_total"),
        F.count_if(F.col("risk_level") == level).alias("in_band"),
        F.count_if(F.col("prediction_label") == name).alias("named"),
    )


# --- evaluation --------------------------------------------------------------

_CM = """count(*) filter (where y = 0 and prediction = 0) as tn, count(*) filter (where y = 0 and prediction = 1) as fp,
  count(*) filter (where y = 1 and prediction = 0) as fn, count(*) filter (where y = 1 and prediction = 1) as tp"""


@check(
    "e01_confusion",
    f"""{WITH_FLOWS}, c as (select {_CM} from fx) select *,
     round(tn * 100.0 / (tn + fp), 4) as tn_percent, round(fp * 100.0 / (tn + fp), 4) as fp_percent,
     round(fn * 100.0 / (fn + tp), 4) as fn_percent, round(tp * 100.0 / (fn + tp), 4) as tp_percent from c""",
)
def confusion(spark, sf_dir):
    return evaluate.confusion_percent(coded(spark, sf_dir))


_METRICS = """d as (select *, tp / cast(tp + fp as double) as pr, tp / cast(tp + fn as double) as rc from c)"""


@check(
    "e02_scores",
    f"""{WITH_FLOWS}, c as (select {_CM} from fx), {_METRICS} select
     round((tp + tn) / cast(tp + tn + fp + fn as double), 4) as accuracy, round(pr, 4) as precision,
     round(rc, 4) as recall, round(2 * pr * rc / (pr + rc), 4) as f1 from d""",
)
def basic_scores(spark, sf_dir):
    return evaluate.scores(coded(spark, sf_dir)).select("accuracy", "precision", "recall", "f1")


@check(
    "e02_scores_without_positives",
    f"{WITH_FLOWS} select round(0.0::double, 4) as precision, round(0.0::double, 4) as recall, round(0.0::double, 4) as f1",
)
def scores_without_positives(spark, sf_dir):
    nothing = coded(spark, sf_dir).filter("label = 0").withColumn("prediction", F.lit(0))
    return evaluate.scores(nothing).select("precision", "recall", "f1")


@check(
    "e03_class_report",
    f"""{WITH_FLOWS}, c as (select {_CM} from fx),
    p as (select 0 as position, 'BENIGN' as class_name, tn / cast(tn + fn as double) as precision,
       tn / cast(tn + fp as double) as recall, tn + fp as support from c
     union all select 1, 'ATTACK', tp / cast(tp + fp as double), tp / cast(tp + fn as double), tp + fn from c),
    q as (select *, 2 * precision * recall / (precision + recall) as f1 from p)
    select position, class_name, round(precision, 4) as precision, round(recall, 4) as recall,
      round(f1, 4) as f1, support from q
    union all select 2, 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
      cast(sum(support) as bigint) from q
    union all select 3, 'weighted avg', round(sum(precision * support) / sum(support), 4),
      round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
      cast(sum(support) as bigint) from q""",
)
def class_report(spark, sf_dir):
    return evaluate.class_report(coded(spark, sf_dir))


@check(
    "e04_error_rates",
    f"""{WITH_FLOWS}, c as (select {_CM} from fx) select round(tn / cast(tn + fp as double), 4) as specificity,
     round(fp / cast(tn + fp as double), 4) as false_positive_rate,
     round(fn / cast(fn + tp as double), 4) as false_negative_rate from c""",
)
def error_rates(spark, sf_dir):
    return evaluate.scores(coded(spark, sf_dir)).select(
        "specificity", "false_positive_rate", "false_negative_rate"
    )


_STEPS = """st as (select score, sum(y) as pos, sum(1 - y) as neg from fx group by score),
 cu as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
   (select sum(y) from fx) as p, (select sum(1 - y) from fx) as q from st)"""


@check(
    "e05_roc_area",
    f"{WITH_FLOWS}, {_STEPS} select round(sum(neg * (2 * tp - pos)) / (2.0 * max(p) * max(q)), 4) as roc_auc from cu",
)
def roc_area(spark, sf_dir):
    return evaluate.curve_areas(coded(spark, sf_dir)).select("roc_auc")


@check(
    "e05_roc_area_one_class",
    f"{WITH_FLOWS} select null::double as roc_auc from (select 1)",
)
def roc_area_one_class(spark, sf_dir):
    return evaluate.curve_areas(coded(spark, sf_dir).filter("label = 0")).select("roc_auc")


@check(
    "e06_roc_curve",
    f"{WITH_FLOWS}, {_STEPS} select round(score, 4) as threshold, round(fp / cast(q as double), 4) as fpr, round(tp / cast(p as double), 4) as tpr from cu",
)
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(coded(spark, sf_dir))


@check(
    "e07_precision_recall_curve",
    f"{WITH_FLOWS}, {_STEPS} select round(score, 4) as threshold, round(tp / cast(tp + fp as double), 4) as precision, round(tp / cast(p as double), 4) as recall from cu",
)
def precision_recall_curve(spark, sf_dir):
    return evaluate.precision_recall_curve(coded(spark, sf_dir))


@check(
    "e07_precision_recall_area",
    f"""{WITH_FLOWS}, {_STEPS}, l as (select *, tp / cast(tp + fp as double) as pr,
      lag(tp / cast(tp + fp as double), 1, 1.0::double) over (order by score desc) as pr0 from cu)
    select round(sum(pos / cast(p as double) * (pr + pr0) / 2), 4) as pr_auc from l""",
)
def precision_recall_area(spark, sf_dir):
    return evaluate.curve_areas(coded(spark, sf_dir)).select("pr_auc")


@check(
    "e08_test_sets",
    f"""{WITH_FLOWS}, n as (select *, capture_id || '-' || protocol as test_name from fx),
    c as (select test_name, {_CM}, count(*) as row_total from n group by test_name),
    d as (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as pr,
      case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as rc from c),
    st as (select test_name, score, sum(y) as pos, sum(1 - y) as neg from n group by 1, 2),
    cu as (select *, sum(pos) over (partition by test_name order by score desc) as tps,
      sum(neg) over (partition by test_name order by score desc) as fps from st),
    l as (select *, lag(tps / cast(tps + fps as double), 1, 1.0::double)
      over (partition by test_name order by score desc) as pr0 from cu),
    ar as (select test_name, sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg)) as roc,
      sum(pos * (tps / cast(tps + fps as double) + pr0)) / (2.0 * sum(pos)) as area from l group by 1)
    select test_name, tn, fp, fn, tp, round((tp + tn) / cast(row_total as double), 4) as accuracy,
     round(pr, 4) as precision, round(rc, 4) as recall,
     round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 4) as f1,
     round(tn / cast(tn + fp as double), 4) as specificity,
     round(fp / cast(tn + fp as double), 4) as false_positive_rate,
     round(case when fn + tp > 0 then fn / cast(fn + tp as double) else 0 end, 4) as false_negative_rate, row_total,
     round(roc, 4) as roc_auc, round(area, 4) as pr_auc from d join ar using (test_name)""",
)
def test_sets(spark, sf_dir):
    rows = coded(spark, sf_dir)
    return evaluate.evaluate_sets(rows.withColumn("test_name", F.concat_ws("-", "capture_id", "protocol")))


@check(
    "e09_prediction_distribution",
    f"""{WITH_FLOWS} select prediction, case when prediction = 0 then 'BENIGN' else 'ATTACK' end as prediction_label,
     count(*) as n, round(count(*) * 100.0 / (select count(*) from fx), 4) as percent from fx group by prediction""",
)
def prediction_distribution(spark, sf_dir):
    return evaluate.prediction_distribution(coded(spark, sf_dir))


@check(
    "e10_expected_shares",
    f"""{WITH_FLOWS}, n as (select *, case when y = 1 then 'attack traffic' when protocol = 'TCP' then 'unnamed'
      else 'normal traffic' end as scenario from fx),
    g as (select scenario, count(*) as row_total, count(*) filter (where prediction =
      case scenario when 'attack traffic' then 1 when 'normal traffic' then 0 end) as as_expected from n group by scenario),
    b as (select *, round(as_expected * 100.0 / row_total, 4) as share,
      cast(case scenario when 'attack traffic' then 80 when 'normal traffic' then 70 end as double) as low,
      cast(case scenario when 'attack traffic' then 95 when 'normal traffic' then 90 end as double) as high from g)
    select *, share between low and high as in_band from b""",
)
def expected_shares(spark, sf_dir):
    scenario = (
        F.when(F.col("label") == 1, "attack traffic")
        .when(F.col("protocol") == "TCP", "unnamed")
        .otherwise("normal traffic")
    )
    return evaluate.expected_share_check(coded(spark, sf_dir).withColumn("scenario", scenario))


# --- streams -----------------------------------------------------------------


def _event_stream(spark, sf_dir, marks):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = run.packet_stream(spark, f"{sf_dir}/events.[p]arquet", events)
    return run.with_end_marks(packets_from_events(stream), marks)


def _complete(spark, sf_dir, make):
    """All flows of the stream, those still open at its end included."""
    out, checkpoint, marks = (scratch_folder(spark, n) for n in ("stream", "offsets", "marks"))
    flows = make(_event_stream(spark, sf_dir, marks))
    run.finish(spark, lambda: run.write_stream(flows, out, checkpoint), marks)
    return spark.read.parquet(out)


_T2 = f"""{WITH_FLOWS}, e1 as (select *, lag(ts_ms) over (partition by capture_id, lo, hi, protocol order by ts_ms, seq) as b from vp),
 e2 as (select *, sum(case when b is null or ts_ms - b > 120000 then 1 else 0 end) over
   (partition by capture_id, lo, hi, protocol order by ts_ms, seq) as no from e1),
 e3 as (select *, s = first_value(s) over (partition by capture_id, lo, hi, protocol, no order by seq) as fwd from e2),
 e4 as (select capture_id, protocol, arg_min(src_ip, seq) as src_ip, arg_min(src_port, seq) as src_port,
   min(ts_ms) as start_ms, max(ts_ms) as end_ms, count(*) filter (where fwd) as total_fwd_packets,
   count(*) filter (where not fwd) as total_bwd_packets,
   cast(coalesce(sum(len) filter (where fwd), 0) as double) as total_fwd_bytes,
   coalesce(stddev_samp(len), 0) as packet_size_std, avg(len) as average_packet_size,
   count(*) filter (where is_dns and not dns_qr) as dns_total_queries,
   count(*) filter (where is_dns and dns_qr) as dns_total_responses, count(*) as n
  from e3 group by capture_id, lo, hi, protocol, no)
 select capture_id, start_ms, src_ip, src_port, protocol, end_ms - start_ms as flow_duration, total_fwd_packets,
  total_bwd_packets, {r4("total_fwd_bytes")}, {r4("packet_size_std")}, {r4("average_packet_size")},
  dns_total_queries, dns_total_responses,
  {r4("case when n > 1 then (end_ms - start_ms) / cast(n - 1 as double) else 0 end", "flow_iat_mean")}
 from e4"""
_T2_COLUMNS = [
    "capture_id",
    "start_ms",
    "src_ip",
    "src_port",
    "protocol",
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "total_fwd_bytes",
    "packet_size_std",
    "average_packet_size",
    "dns_total_queries",
    "dns_total_responses",
    "flow_iat_mean",
]
@check("t02_session_windows", _T2)
def session_windows(spark, sf_dir):
    return _complete(spark, sf_dir, session_flows).select(*_T2_COLUMNS)


@check("t02_session_windows_on_table", _T2)
def session_windows_on_table(spark, sf_dir):
    return session_flows(packets(spark, sf_dir)).select(*_T2_COLUMNS)


@check(
    "t03_arrival_order_stream",
    f"{WITH_FLOWS} select capture_id, start_ms, {sql_columns([c for c, _ in FLOW_FIELDS])} from fl",
)
def arrival_order_stream(spark, sf_dir):
    run.use_rocksdb(spark)
    return _complete(spark, sf_dir, arrival_order_flows)


#: One packet in ten comes after all others; late are those whose session had closed by then.
_LATE = f"""{WITH_VALID}, w as (select max(ts_ms) - 600000 as mark from vp where seq % 10 <> 3),
 late as (select vp.*, mark - ts_ms - 120000 as behind from vp, w where seq % 10 = 3 and ts_ms + 120000 <= mark)"""


def _with_late_packets(spark, sf_dir):
    """Folder of the split and the drained flows of the packets that came in time."""
    source, base, out, offsets, marks = (scratch_folder(spark, n) for n in ("in", "split", "stream", "offsets", "marks"))
    table = packets(spark, sf_dir)

    def split():
        return late.split_late(run.packet_stream(spark, source, table), base)

    table.filter(F.col("seq") % 10 != 3).write.parquet(source)
    run.drain(split())
    table.filter(F.col("seq") % 10 == 3).write.mode("append").parquet(source)
    run.drain(split())

    def start():
        stream = run.with_end_marks(late.on_time_stream(spark, base), marks)
        return run.write_stream(session_flows(stream), out, offsets)

    run.finish(spark, start, marks)
    return base, spark.read.parquet(out)


@check("t04_late_flows", _T2)
def late_flows(spark, sf_dir):
    """Streamed flows with the late packets worked in are those of the whole table."""
    base, flows = _with_late_packets(spark, sf_dir)
    found = late.repaired(flows, late.on_time_packets(spark, base), late.late_packets(spark, base))
    return found.select(*_T2_COLUMNS)


@check(
    "t04_late_counts",
    f"""{_LATE} select capture_id, count(*) as late_packets, count(distinct lo || ' ' || hi || ' ' || protocol) as conversations,
     max(behind) as most_behind_ms from late group by capture_id""",
)
def late_counts(spark, sf_dir):
    base, _ = _with_late_packets(spark, sf_dir)
    return late.late_counts(late.late_packets(spark, base))


@check("t06_resumed_drain", f"with r as ({_T2}) select count(*) as flows, cast(sum(total_fwd_packets) as bigint) as packets from r")
def resumed_drain(spark, sf_dir):
    """A restart between the halves of the table; one more start after the end finds nothing new."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, out, checkpoint, marks = (scratch_folder(spark, n) for n in ("in", "stream", "offsets", "marks"))
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]

    def start():
        stream = packets_from_events(run.packet_stream(spark, source, events))
        return run.write_stream(session_flows(run.with_end_marks(stream, marks)), out, checkpoint)

    events.filter(F.col("event_id") <= middle).write.parquet(source)
    run.drain(start())
    events.filter(F.col("event_id") > middle).write.mode("append").parquet(source)
    run.finish(spark, start, marks)
    run.drain(start())
    flows = spark.read.parquet(out)
    return flows.agg(F.count(F.lit(1)).alias("flows"), F.sum("total_fwd_packets").alias("packets"))


@check("t08_stream_two_sinks", f"with r as ({_T2}) select capture_id, count(*) as flows from r group by capture_id")
def stream_two_sinks(spark, sf_dir):
    out, checkpoint, marks = (scratch_folder(spark, n) for n in ("main", "offsets", "marks"))

    def broken(*_):
        raise ConnectionError("second sink is not reachable")

    flows = session_flows(_event_stream(spark, sf_dir, marks))
    run.finish(spark, lambda: run.write_both(flows, checkpoint, sinks.folder_sink(out), broken), marks)
    back = spark.read.parquet(out)
    return back.groupBy("capture_id").agg(F.count(F.lit(1)).alias("flows"))


@check(
    "t09_scored_stream",
    f"with r as ({_T2}) select count(*) as row_total, cast(0 as bigint) as different from r",
)
def scored_stream(spark, sf_dir):
    """Rows that the stream scores otherwise than the table of the same packets."""
    model = _model(spark, sf_dir, "forest")
    shown = ["capture_id", "start_ms", "src_ip", "src_port", "protocol", "prediction", "risk_level"]

    def scored(packets):
        return run.score_stream(model, session_flows(packets))

    streamed = _complete(spark, sf_dir, scored).select(*shown)
    at_once = scored(packets(spark, sf_dir)).select(*shown)
    return streamed.agg(F.count(F.lit(1)).alias("row_total")).select(
        "row_total", at_once.exceptAll(streamed).agg(F.count(F.lit(1))).scalar().alias("different")
    )


@check("stored_flows", f"{WITH_FLOWS} select capture_id, count(*) as n from fl group by capture_id")
def stored_flows(spark, sf_dir):
    again = stored(flow_table(spark, sf_dir), "again")
    return again.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
