"""Feature encoding, training and scoring with Spark ML.

The protocol encoder is fitted once and stored inside the model, so a batch with
a single protocol is encoded as it was in training.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import (
    MinMaxScaler,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators.forest import Forest
from flowloom.operators.prepare import align_features, clean_values
from flowloom.operators.sampling import stratified_folds
from flowloom.schemas import FEATURE_COLUMNS
from flowloom.tables import stored

SEED = 42

# Settings of the three classifiers.
BOOSTED_DEEP = {"maxDepth": 8, "stepSize": 0.1, "maxIter": 200, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
FOREST = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"}
BOOSTED_LEAFY = {
    "maxDepth": 5,
    "stepSize": 0.05,
    "maxIter": 1000,
    "subsamplingRate": 0.8,
    "minInstancesPerNode": 20,
    "featureSubsetStrategy": "0.9",
}
EARLY_STOP_TOLERANCE = 0.01

# Rows of a training task, at least (if the table has them) and at most.
FEWEST_TASK_ROWS = 5_000
MOST_TASK_ROWS = 1_000_000


def encoded_name(column: str) -> str:
    return f"{column}_index"


def prepare_features(
    flows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """Clean and align a flow table so that a fitted model accepts it."""
    return clean_values(align_features(flows, features, keep))


def feature_stages(
    features: Sequence[str] = FEATURE_COLUMNS,
    categorical: Sequence[str] = ("protocol",),
    scaling: str | None = None,
    one_hot: Sequence[str] = (),
    output: str = "features",
) -> list:
    """Alphabetical index of text features, assembly, optional scaling.

    The index carries nominal metadata, so trees treat it as categorical.
    """
    indexer = StringIndexer(
        inputCols=list(categorical),
        outputCols=[encoded_name(c) for c in categorical],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    inputs = [encoded_name(c) if c in categorical else c for c in features]
    stages: list = [indexer] if categorical else []
    if one_hot:
        wide = [f"{c}_onehot" for c in one_hot]
        stages.append(OneHotEncoder(inputCols=list(one_hot), outputCols=wide, handleInvalid="keep"))
        inputs = [f"{c}_onehot" if c in one_hot else c for c in inputs]
    raw = "features_raw" if scaling else output
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scaling == "standard":
        stages.append(StandardScaler(inputCol=raw, outputCol=output, withMean=True, withStd=True))
    elif scaling == "minmax":
        stages.append(MinMaxScaler(inputCol=raw, outputCol=output))
    elif scaling is not None:
        raise ValueError("scaling must be None, 'standard' or 'minmax'")
    return stages


def classifier(kind: str, label: str = "label", **overrides):
    """``boosted_deep``, ``forest`` or ``boosted_leafy`` with optional changed settings.

    Settings without a Spark counterpart (column sampling per tree rather than
    per node, leaf-wise growth, L1/L2 terms, minimum split size, out-of-bag
    score) are absent.
    """
    common = {"labelCol": label, "featuresCol": "features", "seed": SEED}
    if kind == "boosted_deep":
        return GBTClassifier(**common, **{**BOOSTED_DEEP, **overrides})
    if kind == "forest":
        return Forest(**common, **{**FOREST, "cacheNodeIds": True, **overrides})
    if kind == "boosted_leafy":
        return GBTClassifier(**common, **{**BOOSTED_LEAFY, **overrides})
    raise ValueError(f"unknown classifier: {kind}")


def spread(rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """The same rows in partitions of equal size, alike rows side by side.

    A tree level is a job over all training rows and lasts as long as its largest
    task, so the table is dealt to all cores alike, in whole waves of tasks. Rows
    that are alike meet the same nodes and bins, which stay in the core's cache.
    The table is counted and read, so it should be a stored one.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = rows.count()
    waves = max(1, math.ceil(total / (cores * MOST_TASK_ROWS)))
    tasks = max(1, min(cores * waves, math.ceil(total / FEWEST_TASK_ROWS)))
    return rows.repartition(tasks).sortWithinPartitions(*features)


def fit(
    train: DataFrame,
    kind: str,
    features: Sequence[str] = FEATURE_COLUMNS,
    label: str = "label",
    scaling: str | None = None,
    validation: str | None = None,
    **overrides,
) -> PipelineModel:
    """Fit encoder, assembler and classifier as one model.

    ``validation`` names a boolean column of rows that stop boosting early. The
    rows are prepared and stored once, as a fit passes over them several times.
    """
    if validation is not None and kind != "forest":
        overrides |= {"validationIndicatorCol": validation, "validationTol": EARLY_STOP_TOLERANCE}
    model = classifier(kind, label, **overrides)
    keep = [label] + ([validation] if validation else [])
    stages = feature_stages(features, scaling=scaling) + [model]
    ready = stored(prepare_features(train, features, keep), "training")
    return Pipeline(stages=stages).fit(spread(ready, features))


def score(model: PipelineModel, flows: DataFrame, keep_all: bool = True) -> DataFrame:
    """Attack probability (``score``) and class (``prediction``) next to the input columns.

    Works on streaming tables as well: nothing but projections is added.
    """
    features = _inputs(model)
    originals = [c for c in flows.columns]
    copies = {f"_in_{c}": F.col(c) for c in originals}
    held = flows.withColumns(copies)
    ready = prepare_features(held, features, list(copies))
    scored = model.transform(ready)
    attack = vector_to_array("probability")[1]
    kept = [F.col(f"_in_{c}").alias(c) for c in originals] if keep_all else []
    return scored.select(
        *kept, attack.alias("score"), F.col("prediction").cast("int").alias("prediction")
    )


def _inputs(model: PipelineModel) -> list[str]:
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix("_index") for c in assembler.getInputCols()]


def importances(model: PipelineModel, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Features by importance with their rank; one row per feature of the model."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(_inputs(model), values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    ranked = table.withColumn("rank", rank)
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def training_curve(model: PipelineModel, data: DataFrame, label: str = "label") -> list[float]:
    """Loss after each boosting round on the given table."""
    ready = prepare_features(data, _inputs(model), [label])
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    return list(model.stages[-1].evaluateEachIteration(ready))


def cross_validate(
    data: DataFrame, kind: str, key: Sequence[str], folds: int = 5, label: str = "label", **overrides
) -> DataFrame:
    """One row per fold: ``fold``, ``row_total`` and ``accuracy`` on its rows.

    Every class is spread evenly over the folds. The table is prepared and
    stored once; each fold is scored by a model of the other folds.
    """
    parts = stratified_folds(data, folds, key, label)
    ready = stored(prepare_features(parts, FEATURE_COLUMNS, [label, "fold"]), "folds")
    pipeline = Pipeline(stages=feature_stages() + [classifier(kind, label, **overrides)])
    scored = None
    for fold in range(folds):
        model = pipeline.fit(spread(ready.filter(F.col("fold") != fold)))
        part = model.transform(ready.filter(F.col("fold") == fold)).select("fold", label, "prediction")
        scored = part if scored is None else scored.unionByName(part)
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("row_total"), right.alias("accuracy"))


def save_model(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """Save the model and, next to it, its features and settings as a table."""
    model.write().overwrite().save(f"{path}/model")
    last = model.stages[-1]
    rows = [(i, name, name == "protocol", type(last).__name__, last.getNumTrees) for i, name in enumerate(_inputs(model))]
    schema = "position int, feature string, is_categorical boolean, model_type string, trees int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
