"""Scoring of message tables with a rule, a Spark ML model or a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom.functions.labels import rule_label

ColumnScorer = Callable[[Column], Column]
FrameScorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_records(df: DataFrame, scorer: ColumnScorer = rule_label, message: str = "message") -> DataFrame:
    """Add ``prediction`` by a column function; stays inside the JVM."""
    return df.withColumn("prediction", scorer(F.col(message)))


def score_with_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    from logloom.operators.training import predicted_labels

    return predicted_labels(model, df).withColumnRenamed("predicted_label", "prediction")


def score_in_pandas(df: DataFrame, scorer: FrameScorer) -> DataFrame:
    """Add ``prediction`` by a user's function over batches of rows.

    The function gets an iterator, so it loads its model once per task.
    """
    schema = StructType([*df.schema.fields, StructField("prediction", StringType())])
    return df.mapInPandas(scorer, schema)
