"""Boosted trees on numeric columns, trained and applied by Spark."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES = 12
DEPTH = 4
ROWS = 20_000  # fitted on at most so many, those with the smallest ``order``


def sample(rows: DataFrame, order: str, n: int = ROWS) -> DataFrame:
    """The ``n`` rows with the smallest ``order``."""
    return rows.orderBy(order).limit(n)


def train(rows: DataFrame, features: list[str], label: str) -> GBTClassificationModel | None:
    """Trees that tell ``label`` 1 from 0; None unless there are rows of both."""
    seen = {r[0] for r in rows.select(label).distinct().collect()}  # two values
    if seen != {0, 1}:
        return None
    gathered = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    trees = GBTClassifier(labelCol=label, maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False)
    return trees.fit(gathered.select("features", F.col(label).cast("double").alias(label)))


def score(rows: DataFrame, features: list[str], model: GBTClassificationModel) -> DataFrame:
    """``rows`` with ``score``, the probability of 1."""
    gathered = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    judged = model.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("").transform(gathered)
    return judged.withColumn("score", vector_to_array("_p")[1]).drop("_features", "_p")
