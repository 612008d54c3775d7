"""Scoring: a user's model over model-input rows, and a Spark ML baseline with two heads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.functions import draw_key, micros
from askahead.operators.sampling import at_most
from askahead.schemas import SCORED
from askahead.session import checkpointed

# Per token of a sequence; the mask has a further slot for the duration at position 1.
MODEL_ARRAYS = ["codes", "numeric_values", "time_deltas", "attention_mask"]

# What the baseline reads of model input.
LEARNED = ["subject_id", "prediction_time", "query", "query_id", "duration_days", "duration_years", "censor", "occurs", "codes"]

# A fit keeps its rows in blocks, in memory as far as they fit there and else on disk. Blocks of 1 MB, Spark's default, have
# arrays that take up whole regions of a small heap, more than Spark counts, and the heap runs out.
BLOCK_MB = 0.25

# Gets one Arrow batch of model input (MODEL_ARRAYS, query_id, duration_years), returns occurs_probs, censor_probs and embedding in row order.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def predict_table(inputs: DataFrame, load_scorer: Callable[[], Scorer]) -> DataFrame:
    """Apply a model to every row: (subject_id, prediction_time, code, probabilities, embedding).

    ``load_scorer`` runs once per task, so a model is loaded once and then fed Arrow batches.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for batch in batches:
            out = scorer(batch)
            yield pd.DataFrame(
                {
                    "subject_id": batch["subject_id"],
                    "prediction_time": batch["prediction_time"],
                    "code": batch["query"],
                    "occurs_probs": out["occurs_probs"].to_numpy(),
                    "censor_probs": out["censor_probs"].to_numpy(),
                    "embedding": out["embedding"].to_list(),
                }
            )

    wanted = inputs.select("subject_id", "prediction_time", "query", "query_id", "duration_years", *MODEL_ARRAYS)
    return wanted.mapInPandas(score, SCORED)


@dataclass
class TwoHeadModel:
    features: PipelineModel
    censor: LogisticRegressionModel
    occurs: LogisticRegressionModel

    def transform(self, inputs: DataFrame) -> DataFrame:
        rows = self.features.transform(_with_tokens(inputs))
        p = {}
        for head, model in (("occurs", self.occurs), ("censor", self.censor)):
            rows = model.transform(rows)
            p[head] = vector_to_array(f"{head}_probability")[1]
        return rows.select(
            "subject_id",
            "prediction_time",
            F.col("query").alias("code"),
            p["occurs"].alias("occurs_probs"),
            p["censor"].alias("censor_probs"),
            F.col("censor").alias("boolean_value"),
            (F.col("occurs") == 1).alias("occurs"),
        )


def _with_tokens(inputs: DataFrame) -> DataFrame:
    """History codes and the query as separate words, so that both get their own hashed counts.

    Words are numbers, the query's below zero: nothing is made into text per token.
    """
    history = F.slice("codes", 2, F.greatest(F.size("codes"), F.lit(1)))
    return inputs.withColumn("words", F.concat(history, F.array(-1 - F.col("query_id").cast("int"))))


def training_sample(inputs: DataFrame, max_rows: int, seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows, drawn by a hash of their keys, for trials; the baseline learns from all rows it gets."""
    return at_most(inputs, draw_key(seed, "subject_id", micros("prediction_time"), "query", "duration_days"), max_rows)


def baseline_two_head(inputs: DataFrame, n_features: int = 1 << 12, max_iter: int = 20) -> TwoHeadModel:
    """Logistic regressions on hashed history counts, query and duration.

    The censor head learns from all rows, the occurs head from all uncensored ones. The rows are read once, into a table
    of their features and labels, and learned from where its partitions lie: a step of a fit brings one gradient to the
    driver, however many rows there are.
    """
    inputs = inputs.select(*LEARNED)
    features = Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="counts", numFeatures=n_features),
            VectorAssembler(inputCols=["counts", "duration_years"], outputCol="features"),
        ]
    ).fit(_with_tokens(inputs))
    censor, occurs = F.col("censor").cast("double").alias("censor_y"), F.col("occurs").cast("double").alias("occurs_y")
    rows = checkpointed(features.transform(_with_tokens(inputs)).select("features", censor, occurs))

    def head(name: str, data: DataFrame) -> LogisticRegressionModel:
        return LogisticRegression(
            featuresCol="features",
            labelCol=f"{name}_y",
            maxIter=max_iter,
            regParam=0.01,
            maxBlockSizeInMB=BLOCK_MB,
            probabilityCol=f"{name}_probability",
            rawPredictionCol=f"{name}_raw",
            predictionCol=f"{name}_prediction",
        ).fit(data)

    return TwoHeadModel(features, head("censor", rows), head("occurs", rows.where("censor_y = 0")))
