"""Churn model on the session feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projection(features: DataFrame, label: str = "is_churned", drop: Sequence[str] = ("session_id",), hashed: Sequence[str] = ()) -> list:
    """Stages that turn a feature row into one vector: numbers as they are, texts one-hot.

    Text columns named in ``hashed`` are hashed instead; name those whose value lists would not fit the driver.
    Values unseen in training become zeros.
    """
    texts = [f.name for f in features.schema.fields if f.dataType.typeName() == "string" and f.name not in (*drop, label)]
    inputs = [f.name for f in features.schema.fields if f.name not in (*drop, label, *texts)]
    listed = [c for c in texts if c not in hashed]
    stages: list = []
    if listed:
        stages.append(StringIndexer(inputCols=listed, outputCols=[f"{c}__i" for c in listed], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in listed], outputCols=[f"{c}__v" for c in listed], dropLast=False))
        inputs += [f"{c}__v" for c in listed]
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="__hashed", numFeatures=1 << 14))
        inputs.append("__hashed")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def train(features: DataFrame, label: str = "is_churned", share: float = 0.75, seed: int = 42, depth: int = 5, rounds: int = 20) -> tuple[PipelineModel, DataFrame]:
    """Fit boosted trees on a random share; returns the model and the rows held back."""
    fit, held = features.randomSplit([share, 1 - share], seed)
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed)
    return Pipeline(stages=[*projection(features, label), trees]).fit(fit), held


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Churn probability and decision per session."""
    p = vector_to_array("probability")[1]
    return model.transform(features).select("session_id", p.alias("y_prob"), F.col("prediction").cast("int").alias("y_pred"))
