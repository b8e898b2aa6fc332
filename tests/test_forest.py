"""The forest against Spark's tree and a plain one; what must not depend on sizes or order."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowloom.operators import forest, learn


@pytest.fixture(scope="module")
def rows(spark):
    """Labels by a rule of two numbers and a category, one in eight wrong."""
    draw = np.random.default_rng(3)
    a, b, c = draw.integers(0, 20, 4000), draw.integers(0, 9, 4000), draw.integers(0, 5, 4000)
    label = ((a > 11) ^ (b > 4)) | np.isin(c, [1, 3])
    label ^= draw.random(4000) < 0.125
    made = [(int(i), float(x), float(y), "pqrst"[z], int(k)) for i, (x, y, z, k) in enumerate(zip(a, b, c, label))]
    return spark.createDataFrame(made, "id int, a double, b double, c string, label int").repartition(5).cache()


def pipeline(last):
    index = StringIndexer(inputCol="c", outputCol="ci", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, VectorAssembler(inputCols=["a", "b", "ci"], outputCol="features"), last])


def one_tree(**settings):
    return forest.Forest(numTrees=1, seed=1, featureSubsetStrategy="all", **settings)


@pytest.mark.parametrize(("depth", "least"), [(0, 1), (1, 1), (3, 5), (6, 5), (6, 60)])
def test_a_tree_is_that_of_spark(rows, depth, least):
    shown = ["id", F.round(vector_to_array("probability")[1], 6).alias("p"), "prediction"]
    settings = {"maxDepth": depth, "minInstancesPerNode": least}
    mine = pipeline(one_tree(bootstrap=False, **settings)).fit(rows).transform(rows).select(*shown)
    spark_tree = pipeline(DecisionTreeClassifier(seed=1, **settings)).fit(rows).transform(rows).select(*shown)
    assert mine.exceptAll(spark_tree).count() <= 0.01 * 4000  # splits of the same gain


def test_blocks_of_rows_and_files_give_the_same_tree(monkeypatch):
    draw = np.random.default_rng(0)
    bins = draw.integers(0, 16, (5000, 6)).astype(np.uint8)
    labels = ((bins[:, 0] > 7) ^ (draw.random(5000) < 0.2)).astype(np.uint8)
    s = forest._Settings(2, 16, [True] + [False] * 5, 3, 9, 4, 0.0, 7, 1.0, True)
    blocks = [(0, 0, 0, 3000), (0, 1, 3000, 2000)]
    monkeypatch.setattr(forest, "_NODES", 1)
    found = []
    for most, memory in ((1 << 16, 1 << 30), (700, 100)):
        monkeypatch.setattr(forest, "_ROWS", most)
        monkeypatch.setattr(forest, "_IN_MEMORY", memory)
        room = forest._room(bins.shape, np.uint8)
        assert isinstance(room, np.memmap) == (memory == 100)
        room[:] = bins
        found.append(forest._grow(room, labels, forest._in_bag(blocks, 5000, 0, s), 0, s))
    assert len(found[0][0]) > 100
    for first, second in zip(*found):
        np.testing.assert_allclose(first, second)
    swapped = forest._in_bag([(0, 1, 0, 2000), (0, 0, 2000, 3000)], 5000, 0, s)
    np.testing.assert_array_equal(np.roll(swapped, 3000), forest._in_bag(blocks, 5000, 0, s))


def test_every_row_of_a_node_is_counted():
    """Shares of the leaves are those of the rows that get there, weighted as drawn."""
    draw = np.random.default_rng(2)
    bins, labels = draw.integers(0, 9, (3000, 5)).astype(np.uint8), draw.integers(0, 3, 3000).astype(np.uint8)
    s = forest._Settings(3, 9, [False, True, False, False, False], 2, 7, 3, 0.0, 7, 1.0, True)
    weights = forest._in_bag([(0, 0, 0, 3000)], 3000, 5, s)
    feature, cut, child, share, importance = forest._grow(bins, labels, weights, 5, s)
    assert len(feature) == 2 * (feature >= 0).sum() + 1
    leaf = forest._leaves(bins, feature, cut, child, s.categories)
    for node in np.unique(leaf):
        inside = (leaf == node) & (weights > 0)
        counts = np.bincount(labels[inside], weights[inside], 3)
        assert counts.sum() >= 3 or node == 0
        np.testing.assert_allclose(share[node] / forest._WHOLE, counts / counts.sum(), atol=1e-8)
    assert importance.sum() == pytest.approx(1) and (feature[leaf] == -1).all() and (feature >= 0).sum() > 50


def test_a_forest_learns_and_is_saved_whole(spark, rows, folder):
    fitted = pipeline(forest.Forest(numTrees=12, maxDepth=8, seed=5)).fit(rows)
    last = fitted.stages[-1]
    assert (last.getNumTrees, last.getOrDefault("maxDepth"), len(last.featureImportances)) == (12, 8, 3)
    scored = fitted.transform(rows).withColumn("p", vector_to_array("probability"))
    facts = scored.agg(
        F.avg((F.col("prediction") == F.col("label")).cast("int")),
        F.max(F.abs(F.col("p")[0] + F.col("p")[1] - 1)),
        F.count_if((F.col("p")[1] > 0.5) != (F.col("prediction") == 1)),
    ).first()
    assert facts[0] > 0.8 and facts[1] < 1e-12 and facts[2] == 0
    fitted.write().overwrite().save(folder)
    again = PipelineModel.load(folder)
    assert again.transform(rows).select("id", "probability").exceptAll(scored.select("id", "probability")).count() == 0
    assert list(again.stages[-1].featureImportances) == list(last.featureImportances)
    # The same settings and rows give the same forest.
    twice = pipeline(forest.Forest(numTrees=12, maxDepth=8, seed=5)).fit(rows).transform(rows)
    assert twice.select("id", "probability").exceptAll(scored.select("id", "probability")).count() == 0


def test_trees_stay_out_of_the_driver(rows):
    """A model holds thresholds and importances, whatever its trees are."""
    fitted = pipeline(learn.classifier("forest", numTrees=5)).fit(rows).stages[-1]
    held = [v for v in vars(fitted).values() if isinstance(v, np.ndarray)]
    assert sum(v.nbytes for v in held) < 100
    assert fitted.path and sum(len(cuts or ()) for cuts in fitted.splits) == 19 + 8


def test_thresholds_use_all_rows():
    assert forest.thresholds(np.array([1.0, 2, 5]), np.array([1, 1, 1]), 32).tolist() == [1.5, 3.5]
    values = np.arange(1000.0)
    found = forest.thresholds(*forest._merged(values, np.ones(1000)), 32)
    assert len(found) == 31 and np.allclose(found, np.arange(1, 32) * 31.25, atol=1)
    many = np.random.default_rng(1).random(100_000)
    points, counts = forest._merged(many, np.ones(100_000))
    assert len(points) <= forest._POINTS + 1 and counts.sum() == 100_000
    assert np.allclose(forest.thresholds(points, counts, 32), np.arange(1, 32) / 32, atol=0.01)


def test_tables_that_have_no_forest(spark, rows):
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    with pytest.raises(ValueError, match="no training rows"):
        one_tree().fit(ready.limit(0))
    one_class = pipeline(forest.Forest(numTrees=2, seed=1)).fit(rows.withColumn("label", F.lit(0)))
    assert {r.prediction for r in one_class.transform(rows).collect()} == {0.0}
    with pytest.raises(ValueError, match="Gini"):
        pipeline(forest.Forest(impurity="entropy")).fit(rows)


@pytest.mark.parametrize(("strategy", "wanted"), [("auto", 6), ("sqrt", 6), ("all", 36), ("log2", 6), ("onethird", 12), ("0.5", 18), ("1.0", 36), ("7", 7)])
def test_number_of_features_of_a_node(strategy, wanted):
    assert forest._subset(strategy, 36, 10) == wanted
