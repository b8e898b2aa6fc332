"""Training, stored encoders and the three ways through the library."""

import math
import re

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from flowchecks.base import flow_table
from flowloom.operators import evaluate, learn, prepare, sampling
from flowloom.plans.flow_tables import detect, trained_model


@pytest.fixture(scope="module")
def flows(spark, data_dir):
    return flow_table(spark, data_dir).withColumn("label", F.col("y")).drop("score")


@pytest.fixture(scope="module")
def forest(flows):
    return learn.fit(flows, "forest", numTrees=4, maxDepth=4)


def test_protocol_keeps_its_code_in_a_single_protocol_batch(forest, flows):
    only_udp = flows.filter("protocol = 'UDP'")
    ready = learn.prepare_features(only_udp)
    coded = forest.stages[0].transform(ready).select("protocol_index").distinct().collect()
    assert [r.protocol_index for r in coded] == [1.0]


def test_scoring_keeps_rows_and_columns(forest, flows):
    made = learn.score(forest, flows)
    assert made.columns == [*flows.columns, "score", "prediction"]
    assert made.count() == flows.count()
    partial = learn.score(forest, flows.drop("flow_iat_std").withColumn("extra", F.lit(1)))
    assert partial.count() == flows.count()


def test_saved_model_scores_alike(spark, forest, flows, folder):
    learn.save_model(forest, folder, spark)
    again = learn.load_model(folder)
    features = spark.read.parquet(f"{folder}/features").orderBy("position").collect()
    assert len(features) == 36
    assert [f.feature for f in features if f.is_categorical] == ["protocol"]
    first = learn.score(forest, flows).select("first_seq", "score")
    assert first.exceptAll(learn.score(again, flows).select("first_seq", "score")).count() == 0


def test_forest_keeps_the_node_of_each_row(forest):
    assert learn.classifier("forest").getCacheNodeIds()
    assert not learn.classifier("forest", cacheNodeIds=False).getCacheNodeIds()
    assert forest.stages[-1].getOrDefault("cacheNodeIds")


def test_training_rows_are_dealt_evenly_and_alike_ones_together(spark):
    uneven = spark.range(40_000).select((F.col("id") % 7).alias("a"), "id").coalesce(1)
    made = learn.spread(uneven, ["a"])
    rows = [[r.a for r in part] for part in made.rdd.glom().collect()]
    assert [len(part) for part in rows] == [5_000] * 8
    assert all(part == sorted(part) for part in rows)
    assert made.exceptAll(uneven).count() == 0
    assert learn.spread(uneven.limit(3), ["a"]).rdd.getNumPartitions() == 1


def test_training_and_scoring_run_in_methods_that_are_compiled(forest, flows, capsys):
    """The JVM interprets methods of more than 8000 bytes."""
    train = sampling.hash_split(flows, 0.2, ["first_seq"]).filter("split = 'train'")
    ready = learn.prepare_features(train, learn.FEATURE_COLUMNS, ["label"])
    encoder = Pipeline(stages=learn.feature_stages()).fit(ready)
    for table in (encoder.transform(ready).select("features", "label"), learn.score(forest, flows, keep_all=False)):
        capsys.readouterr()
        table.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000


def test_missing_and_infinite_values_of_both_float_types(spark):
    values = [1.5, -0.0, None, math.nan, math.inf, -math.inf]
    rows = spark.createDataFrame([(v, v, None if v is None else 3, None) for v in values], "d double, f float, n int, s string")
    for inf_value, put in ((None, 7.0), (math.nan, 7.0), (-1.0, -1.0)):
        made = prepare.clean_values(rows, inf_value, 7.0)
        assert dict(made.dtypes)["f"] == ("float" if inf_value is None else "double")
        kept = made.collect()
        assert [r.d for r in kept] == [r.f for r in kept] == [1.5, 0.0, 7.0, 7.0, put, put]
        assert [r.n for r in kept] == [3, 3, 7, 3, 3, 3]
        assert {r.s for r in kept} == {"0"}


def test_boosting_stops_early(flows):
    marked = flows.withColumn("held", F.col("first_seq") % 3 == 0)
    model = learn.fit(marked, "boosted_leafy", validation="held", maxIter=12, maxDepth=2, stepSize=1.0)
    assert model.stages[-1].getNumTrees <= 12
    assert len(learn.training_curve(model, flows)) == model.stages[-1].getNumTrees


def test_importances_are_ranked(spark, forest):
    rows = learn.importances(forest, spark).collect()
    assert len(rows) == 36
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert [r.rank for r in rows] == list(range(1, 37))


def test_train_test_detect(flows):
    tagged = flows.withColumn("source", F.col("capture_id"))
    model, metrics = trained_model(
        tagged.filter("label = 1"),
        tagged.filter("label = 0"),
        ["first_seq"],
        kind="forest",
        quotas={"cap0": 30},
        numTrees=3,
        maxDepth=3,
    )
    row = metrics.first()
    assert row.test_name == "test"
    assert 0.0 <= row.accuracy <= 1.0
    found = detect(model, flows)
    assert {"timestamp_range", "confidence_score", "risk_level"} <= set(found.columns)
    assert "ttl_violation_rate" not in found.columns
    assert found.count() == flows.count()


def test_scores_by_test_set(forest, flows):
    made = learn.score(forest, flows).withColumn("test_name", F.col("capture_id"))
    rows = evaluate.evaluate_sets(made).collect()
    assert {r.test_name for r in rows} == {"cap0", "cap1"}
    assert sum(r.row_total for r in rows) == flows.count()
