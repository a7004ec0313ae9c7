"""Distributed forests: three regressors against persistence, and the event classifier."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schema as S

TREES = 200
SEED = 42
# Trees are grown level by level on binned features; the depth bounds a tree's size. The library's
# limit is 30, where a level may hold a node per row; 10 keeps at most 1,024 leaves a tree.
MAX_DEPTH = 10
# Partitions of the training rows: part of what a seed means, so a parameter of the call and not of the cluster. A level of the
# trees is one task a partition: for the ten thousands of rows of the bench 16 take 13 s, 64 took 29 s. Raise it with the table.
PARTITIONS = 16
# Forests that grow at the same time, up to so many training rows. Each keeps its binned rows in memory, about 1 KB a row at 200
# trees; beyond, two would push each other's rows to disk and leave the executors' heaps full.
AT_ONCE, AT_ONCE_ROWS = 2, 500_000
FOREST = {"numTrees": TREES, "seed": SEED, "maxDepth": MAX_DEPTH}
# Node ids are kept with the rows instead of walking every tree for every row and level,
# and more memory for node statistics means fewer passes over the data.
SCALING = {"cacheNodeIds": True, "maxMemoryInMB": 1024}
# A regressor looks at all features, so its nodes have several times a classifier's statistics. Every running task holds up to 4/3 of
# this memory for them, outside of what Spark keeps account of; a smaller share is more passes and the same trees. Node ids are 0.8 KB
# a row, copied at every pass and kept up to three times: walking the trees takes as long and keeps nothing.
REGRESSOR_SCALING = {"cacheNodeIds": False, "maxMemoryInMB": 128}


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(S.FEATURES), outputCol="features")


def _spread(train: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Rows dealt by a hash of their key into a fixed number of ordered partitions.

    Bags are drawn per partition, so the same rows and seed give the same forest on any cluster
    and for any layout of the input. Inside a partition like rows follow each other (the key decides between equal ones): they
    are in the same nodes of most trees, so a level goes through the nodes' statistics in runs and not at random.
    """
    key = [c for c in ("basin", "hour_idx") if c in train.columns]
    return train.repartition(partitions, F.xxhash64(*(key or S.FEATURES))).sortWithinPartitions(*S.FEATURES, *key)


def fit_regressor(
    train: DataFrame, target: str, weight: str | None = None, partitions: int = PARTITIONS, **params
) -> PipelineModel:
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, predictionCol="prediction",
        featureSubsetStrategy="all", **(FOREST | REGRESSOR_SCALING | params),
    )
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[_assembler(), forest]).fit(_spread(train, partitions))


def fit_classifier(
    train: DataFrame, label: str = "label", weight: str = "class_weight", partitions: int = PARTITIONS, **params
) -> PipelineModel:
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol=weight, **(FOREST | SCALING | params)
    )
    return Pipeline(stages=[_assembler(), forest]).fit(_spread(train, partitions))


def at_once(train: DataFrame) -> int:
    """How many forests on these rows may grow at the same time."""
    return AT_ONCE if train.count() <= AT_ONCE_ROWS else 1


def fit_side_by_side(spark: SparkSession, fits: list[Callable[[], PipelineModel]], at_once: int = AT_ONCE) -> list[PipelineModel]:
    """The models of independent fits, in order, ``at_once`` of them at a time: one's tasks run while another is at its driver step."""
    with ThreadPool(at_once) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits, chunksize=1)


def predict(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df).withColumn(name, F.col("prediction"))
    return out.select(*df.columns, name)


def predict_delta(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Forecast rebuilt from the current runoff and the predicted change."""
    out = predict(model, df, "_change")
    return out.withColumn(name, F.col("Q_actual") + F.col("_change")).drop("_change")


def score(model: PipelineModel, df: DataFrame, name: str = "proba_modelo") -> DataFrame:
    """Probability of the event class for complete feature rows."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Features by importance, descending; equal ones keep the feature order."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(S.FEATURES, map(float, weights)), key=lambda r: -r[1])
    ranked = [(i + 1, f, w) for i, (f, w) in enumerate(rows)]
    return spark.createDataFrame(ranked, "rank int, feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
