"""Ordering, sampling, profile, repair and evaluation helpers on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import evaluate, ordered, prepare, profile, repair, report, sampling
from flowloom.schemas import FEATURE_COLUMNS, FLOW_COLUMNS
from flowloom.sources import sinks


def numbers(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("kind", ["uniform", "skewed", "few"])
def test_exact_quantiles_match_linear_interpolation(spark, kind):
    rng = random.Random(7)
    values = {
        "uniform": [rng.random() for _ in range(777)],
        "skewed": [0.0] * 500 + [rng.expovariate(1) for _ in range(301)],
        "few": [3.0, 1.0],
    }[kind]
    row = ordered.exact_quantiles(numbers(spark, values), [], "v", profile.QUARTILES).first()
    expected = np.quantile(values, [0.25, 0.5, 0.75])
    assert [row.q25, row.q50, row.q75] == pytest.approx(list(expected))


def test_quantiles_of_groups_with_odd_values(spark):
    rng = random.Random(8)
    groups = {
        "hot": [0.0] * 3000 + [-0.0] * 500 + [rng.gauss(0, 1e-300) for _ in range(50)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(999)],
        "edge": [float("inf"), float("-inf"), 1e308, -1e308, 5e-324, -5e-324],
        "one": [7.5],
        None: [1.0, 2.0, 2.0, 4.0],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("none", None), ("one", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"low": 0.0, "q30": 0.3, "q50": 0.5, "top": 1.0}
    found = {r.g: r for r in ordered.exact_quantiles(frame, ["g"], "v", probs).collect()}
    assert set(found) == set(groups)
    for g, own in groups.items():
        for name, p in probs.items():
            at = p * (len(own) - 1)
            low, high = sorted(own)[int(np.floor(at))], sorted(own)[int(np.ceil(at))]
            wanted = low + (high - low) * (at - np.floor(at))
            assert found[g][name] == wanted or (np.isnan(wanted) and np.isnan(found[g][name]))
    assert ordered.exact_quantiles(frame.limit(0), ["g"], "v", probs).count() == 0


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_running_totals_do_not_depend_on_ranges(spark, partitions):
    rows = [("a", float(i), 1 + i % 3) for i in range(100)] + [("b", float(i), 2) for i in range(10)]
    rows += [(None, float(i), 5) for i in range(7)] + [("a", None, 4)]
    counted = spark.createDataFrame(rows, "g string, v double, n bigint")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = ordered.running_totals(counted, ["g"], "v", ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found.sort(key=lambda r: (r.g or "", r.v is not None, r.v or 0.0))
    seen = {}
    for row in found:
        before = seen.get(row.g, 0)
        assert row.n_before == before
        seen[row.g] = before + row.n
        assert row.n_upto == seen[row.g]
    assert all(row.n_all == seen[row.g] for row in found)
    assert len(found) == 118


def test_running_totals_of_many_values_and_a_hot_one(spark):
    """Ten million distinct values, and one value that holds half of all rows, collapsed before."""
    n = 10_000_000
    counted = spark.range(n).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") == 77, n).otherwise(1).alias("n"))
    totals = ordered.running_totals(counted, [], "v", ["n"])
    expected = F.col("v").cast("bigint") + F.when(F.col("v") > 77, n - 1).otherwise(0)
    wrong = totals.filter((F.col("n_before") != expected) | (F.col("n_upto") != expected + F.col("n")) | (F.col("n_all") != 2 * n - 1))
    assert totals.count() == n and wrong.count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_changes_do_not_depend_on_chunks(spark, span):
    rng = random.Random(1)
    labels = [rng.randrange(2) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(labels)), "pos bigint, label int")
    expected = 1 + sum(a != b for a, b in zip(labels, labels[1:]))
    found = ordered.changes_in_order(rows, "pos", "label", span).first()
    assert (found.row_total, found.label_changes, found.is_shuffled) == (200, expected, True)


def test_exact_sample_is_exact_and_repeatable(spark):
    rows = spark.range(5000).withColumn("x", F.lit("same"))
    first = sampling.exact_sample(rows, 1234, ["id"])
    again = sampling.exact_sample(rows.repartition(7), 1234, ["id"])
    ids = {r.id for r in first.collect()}
    assert len(ids) == 1234
    assert ids == {r.id for r in again.collect()}
    assert ids != {r.id for r in sampling.exact_sample(rows, 1234, ["id"], seed=1).collect()}
    assert sampling.exact_sample(rows, 0, ["id"]).count() == 0
    assert sampling.exact_sample(rows, 9999, ["id"]).count() == 5000


def test_exact_sample_with_equal_hashes(spark):
    rows = spark.range(100).withColumn("k", F.lit(1))
    assert sampling.exact_sample(rows, 30, ["k"]).count() == 30


def test_balance_keeps_other_classes_whole(spark):
    rows = spark.range(900).withColumn("kind", F.concat(F.lit("k"), F.col("id") % 3))
    cut = sampling.balance_classes(rows, "kind", {"k0": 10, "k1": 0, "k9": 5}, ["id"])
    counts = {r.kind: r["count"] for r in cut.groupBy("kind").count().collect()}
    assert counts == {"k0": 10, "k2": 300}


def test_stratified_split_is_exact_and_whole(spark):
    rows = spark.range(1000).withColumn("label", F.when(F.col("id") < 100, 1).when(F.col("id") < 990, 0))
    split = sampling.stratified_split(rows, 0.2, ["id"])
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts[1, "test"] == 20
    assert counts[0, "test"] == 178
    assert counts[None, "test"] == 2
    assert sum(counts.values()) == 1000


def test_sampling_plan_has_no_global_sort(spark):
    rows = spark.range(1000)
    text = sampling.exact_sample(rows, 10, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("count", [4, 5, 6, 7])
def test_picked_positions(spark, count):
    rows = spark.range(count).withColumn("pos", F.col("id") * 10)
    picks = {r.pick: r.id for r in sampling.pick_positions(rows, "pos", span=15).collect()}
    assert picks == {"top": 0, "middle": round(count / 2), "bottom": count - 1}


def test_cleaning_and_alignment(spark):
    rows = spark.createDataFrame(
        [(float("inf"), None, "UDP", 1), (float("nan"), 2.0, None, 0)],
        "flow_iat_std double, flow_iat_mean double, protocol string, label int",
    )
    clean = prepare.clean_values(rows).collect()
    assert [r.flow_iat_std for r in clean] == [0.0, 0.0]
    assert clean[0].flow_iat_mean == 0.0
    assert clean[1].protocol == "0"
    assert prepare.clean_values(rows, inf_value=-1.0).first().flow_iat_std == -1.0
    aligned = prepare.align_features(rows, keep=["label"])
    assert aligned.columns == [*FEATURE_COLUMNS, "label"]
    found = prepare.alignment_report(rows.withColumn("src_ip", F.lit("x")))
    assert found["expected"] == 36
    assert found["extra"] == ["src_ip"]
    assert "src_ip" in found["identity_like"]
    assert len(found["missing"]) == 33


def test_numeric_only_if_every_value_parses(spark):
    rows = spark.createDataFrame([("1", "1", "a"), ("2.5", "x", None)], "a string, b string, c string")
    kinds = dict(prepare.numeric_if_all_parse(rows).dtypes)
    assert kinds == {"a": "double", "b": "string", "c": "string"}


def test_line_repair(spark):
    fields = [f"{i}" for i in range(40)]
    fields[0], fields[1], fields[4] = "10.0.0.1", "192.0.2.1", "UDP"
    line = ",".join(fields)
    lines = [line, line + ",", "7," + line, line + ",x,y", ",".join(FLOW_COLUMNS), "broken"]
    table = spark.createDataFrame([(v,) for v in lines], "value string")
    status = [r.s for r in table.select(repair.line_status(F.col("value")).alias("s")).collect()]
    assert status == ["ok", "trailing", "indexed", "malformed", "header", "malformed"]
    fixed = repair.repair_lines(table).collect()
    assert len(fixed) == 3
    assert {r.src_ip for r in fixed} == {"10.0.0.1"}
    assert {r.average_packet_size for r in fixed} == {39.0}


def test_export_has_no_trailing_comma(spark):
    from flowloom.operators.flow_features import flow_features
    from flowloom.schemas import PACKET_SCHEMA
    from tests.model import packet

    flows = flow_features(spark.createDataFrame([packet(1, 1704067200000)], PACKET_SCHEMA))
    line = sinks.export_lines(flows, labelled=False).first().line
    assert len(line.split(",")) == 40
    assert not line.endswith(",")
    labelled = sinks.export_lines(flows.withColumn("label", F.lit("BENIGN")), labelled=True).first().line
    assert labelled.endswith(",BENIGN")


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_areas_with_ties(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(500):
        label = rng.randrange(2)
        rows.append((label, 0, round(min(1.0, max(0.0, rng.gauss(0.45 + 0.1 * label, 0.2))), 1)))
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    row = evaluate.curve_areas(scored(spark, rows)).first()
    assert row.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_areas_agree_with_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(5)
    rows = [(rng.randrange(2), 0, rng.random()) for _ in range(300)]
    table = scored(spark, rows)
    check = BinaryClassificationEvaluator(rawPredictionCol="score", metricName="areaUnderROC", numBins=0)
    assert evaluate.curve_areas(table).first().roc_auc == pytest.approx(check.evaluate(table))


def test_single_class_has_no_roc_area(spark):
    row = evaluate.curve_areas(scored(spark, [(0, 0, 0.1), (0, 1, 0.9)])).first()
    assert row.roc_auc is None
    counts = evaluate.scores(scored(spark, [(0, 0, 0.1)])).first()
    assert (counts.tp, counts.precision, counts.f1) == (0, 0.0, 0.0)


def test_risk_levels_at_their_bounds(spark):
    scores = [0.95, 0.9, 0.8999, 0.8, 0.6, 0.55, 0.05]
    rows = spark.createDataFrame([(s,) for s in scores], "score double")
    made = report.detection_report(rows, time_text="t").collect()
    assert [r.risk_level for r in made] == [
        "CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "CRITICAL",
    ]
    attack = report.detection_report(rows, risk_on="attack", time_text="t").collect()
    assert attack[-1].risk_level == "LOW"


def test_time_range_falls_back_to_now(spark):
    rows = spark.createDataFrame([("no time",)], "timestamp string")
    assert profile.time_range(rows).first()[0].startswith("Detection Time: ")
    assert profile.time_range(rows.select(F.lit(1).alias("x"))).first()[0].startswith("Detection Time: ")


def test_time_column_preference(spark):
    rows = spark.createDataFrame(
        [("2024-01-02 00:00:00", "2020-01-01 00:00:00"), ("bad", "2020-01-01 00:00:00")],
        "time string, start_time string",
    )
    assert profile.time_range(rows).first()[0] == "2024-01-02 00:00:00 to 2024-01-02 00:00:00"


def test_second_sink_failure_is_not_fatal(spark, folder):
    def broken(*_):
        raise OSError("gone")

    seen = []
    write = sinks.tee(sinks.folder_sink(f"{folder}/main"), broken)
    write(spark.range(5))
    write(spark.range(5))
    assert spark.read.parquet(f"{folder}/main").count() == 5
    sinks.tee(sinks.folder_sink(f"{folder}/main"), lambda rows, n: seen.append((n, rows.count())))(spark.range(7), 1)
    assert spark.read.parquet(f"{folder}/main").count() == 12
    assert seen == [(1, 7)]
    with pytest.raises(OSError, match="gone"):
        sinks.tee(broken, lambda *_: None)(spark.range(5))


@pytest.mark.parametrize("per_block", [1, 3, 1000])
def test_before_chunks_for_every_block_size(spark, monkeypatch, per_block):
    monkeypatch.setattr(ordered, "CHUNKS_PER_BLOCK", per_block)
    rows = [(g, c * 2, (c * 7) % 5, None if c % 3 else c) for g in "ab" for c in range(11)]
    table = spark.createDataFrame(rows, "g string, chunk bigint, n int, v int")
    wanted = {"total": ("sum", "n"), "top": ("max", "n"), "seen": ("last", "v")}
    for row in ordered.before_chunks(table, ["g"], wanted).collect():
        earlier = [r for r in rows if r[0] == row.g and r[1] < row.chunk]
        assert row.total == sum(r[2] for r in earlier)
        assert row.top == max((r[2] for r in earlier), default=None)
        assert row.seen == next((r[3] for r in reversed(earlier) if r[3] is not None), None)
