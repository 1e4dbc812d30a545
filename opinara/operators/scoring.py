"""One hook for text scorers: a Spark ML model, an object with ``predict_proba``, or a column expression.

Whatever scores texts here (global sentiment, the four aspect modes) takes any of the three. Objects are loaded once for
each Python worker and called with batches; a text that many rows share is scored once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shared import shared_folder, stored

#: Texts given to an object at a time.
BATCH = 1024


class Scorer:
    """score(df, text, into): df with the score, between 0 and 1, of the texts in a column; a null text counts as ''."""

    def score(self, df: DataFrame, text: str = "text", into: str = "sentiment_score") -> DataFrame:
        raise NotImplementedError


class ColumnScorer(Scorer):
    """A function from a text column to a score column."""

    def __init__(self, expression: Callable[[Column], Column]):
        self.expression = expression

    def score(self, df: DataFrame, text: str = "text", into: str = "sentiment_score") -> DataFrame:
        return df.withColumn(into, self.expression(F.coalesce(F.col(text), F.lit(""))))


class _ByText(Scorer):
    """Scores each distinct text once, into a table by the text's SHA-256, and looks the rows' scores up there.

    Only the digest goes with the rows; of a text that many rows hold, each task passes one copy on.
    """

    def _distinct(self, texts: DataFrame) -> DataFrame:
        """(name, score) of (name, text)."""
        raise NotImplementedError

    def score(self, df: DataFrame, text: str = "text", into: str = "sentiment_score") -> DataFrame:
        named = df.withColumn("_name", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
        texts = named.select("_name", F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy(
            F.col("_name").alias("name")
        ).agg(F.first("text").alias("text"))
        scores = stored(self._distinct(texts).select(F.col("name").alias("_name"), F.col("score").alias(into)))
        return named.join(scores, "_name", "left").select(*[f"`{c}`" for c in df.columns], into)


def without_summary(model: Model) -> Model:
    """The model as it is read back from a file, if it or a stage of it has a training summary.

    A summary holds the session, which goes to the tasks with the model and can't be sent once anything was observed in it.
    """
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if not any(getattr(s, "hasSummary", False) for s in stages):
        return model
    path = shared_folder(SparkSession.active())
    model.save(path)
    return type(model).load(path)


class ModelScorer(_ByText):
    """A fitted Spark ML pipeline that reads ``text`` and gives ``probability``; the score is that of label 1."""

    def __init__(self, model: Model):
        self.model = without_summary(model)

    def _distinct(self, texts: DataFrame) -> DataFrame:
        return self.model.transform(texts).select("name", vector_to_array("probability")[1].alias("score"))


class ObjectScorer(_ByText):
    """Any object with ``predict_proba(list[str])``, made by ``load()`` once in each Python worker.

    predict_proba gives a score for each text, or a row per text whose last number is that of label 1.
    """

    def __init__(self, load: Callable[[], Any], batch: int = BATCH):
        self.load, self.batch = load, batch

    def _distinct(self, texts: DataFrame) -> DataFrame:
        load = self.load

        def make() -> Callable[[np.ndarray], np.ndarray]:
            scorer = load()

            def predict(batch: np.ndarray) -> np.ndarray:
                out = np.asarray(scorer.predict_proba([str(t) for t in batch]), float)
                return out if out.ndim == 1 else out[:, -1]

            return predict

        udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=self.batch)
        return texts.select("name", udf("text").alias("score"))


def as_scorer(scorer: Any) -> Scorer:
    """A Scorer of whatever a caller has; an object with predict_proba is sent to the workers as it is."""
    if isinstance(scorer, Scorer):
        return scorer
    if isinstance(scorer, Model):
        return ModelScorer(scorer)
    if hasattr(scorer, "predict_proba"):
        return ObjectScorer(lambda: scorer)
    if callable(scorer):
        return ColumnScorer(scorer)
    raise TypeError(f"{type(scorer).__name__} scores no texts: it is no model, has no predict_proba and can't be called")
