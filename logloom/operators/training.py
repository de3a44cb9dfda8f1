"""Training: candidate settings, model selection and the final test, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom import domain
from logloom.functions.labels import label_id
from logloom.operators import quality, splits
from logloom.session import checkpointed

# Settings of the text classifier, each with its default.
DEFAULTS = {"reg_param": 0.01, "num_features": 4096, "max_iter": 20, "elastic_net": 0.0, "min_doc_freq": 1}


def candidate_grid(spark: SparkSession, options: Mapping[str, Sequence], max_trials: int, seed: int = 42) -> DataFrame:
    """Distinct combinations of the options in seeded random order, at most ``max_trials``.

    One array per setting is unfolded after the other; the lists are settings, not data.
    """
    grid = spark.range(1).select(*[F.array_distinct(F.array(*[F.lit(v) for v in vs])).alias(k) for k, vs in options.items()])
    return shuffled_grid(grid, list(options), max_trials, seed)


def shuffled_grid(option_lists: DataFrame, names: Sequence[str], max_trials: int, seed: int = 42) -> DataFrame:
    grid = option_lists
    for name in names:
        grid = grid.withColumn(name, F.explode(name))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]).cast("binary"))
    return grid.select(*names, draw.alias("draw")).orderBy("draw").limit(max(max_trials, 1))


def text_pipeline(config: Mapping[str, float], message: str = "message") -> Pipeline:
    words = RegexTokenizer(inputCol=message, outputCol="words", pattern=r"\W+", minTokenLength=1)
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=int(config["num_features"]))
    weights = IDF(inputCol="counts", outputCol="features", minDocFreq=int(config["min_doc_freq"]))
    classifier = LogisticRegression(
        labelCol="label", featuresCol="features", maxIter=int(config["max_iter"]),
        regParam=float(config["reg_param"]), elasticNetParam=float(config["elastic_net"]),
    )
    return Pipeline(stages=[words, counts, weights, classifier])


def predicted_labels(model: PipelineModel, df: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Rows with ``predicted_label``; the model travels once per job."""
    names = F.array(*[F.lit(x) for x in labels])
    return model.transform(df).withColumn("predicted_label", F.element_at(names, F.col("prediction").cast("int") + 1)).drop(
        "words", "counts", "features", "rawPrediction", "probability", "prediction"
    )


def evaluate(model: PipelineModel, df: DataFrame, labels: Sequence[str] = domain.LABELS) -> dict[str, float]:
    """Accuracy, macro and weighted F1 of the model on labelled rows."""
    counts = quality.confusion_counts(predicted_labels(model, df, labels), "class")
    row = quality.summary_metrics(quality.per_class_metrics(counts, labels)).first()
    return {m: float(row[m]) for m in quality.METRICS}


def run_trials(df: DataFrame, configs: Sequence[Mapping[str, float]], pairs: Sequence[tuple[DataFrame, DataFrame]], labels: Sequence[str]) -> DataFrame:
    """One row per trial and fold: fit on the first table of a pair, judge on the second."""
    rows = []
    for trial, config in enumerate(configs, start=1):
        for fold, (fit_rows, judge_rows) in enumerate(pairs, start=1):
            metrics = evaluate(text_pipeline(config).fit(fit_rows), judge_rows, labels)
            rows.append((trial, fold, metrics["macro_f1"], metrics["weighted_f1"], metrics["accuracy"]))
    return df.sparkSession.createDataFrame(rows, "trial_index int, fold int, macro_f1 double, weighted_f1 double, accuracy double")


def train_classifier(
    df: DataFrame,
    configs: Sequence[Mapping[str, float]] = (DEFAULTS,),
    test_size: float = 0.15,
    val_size: float = 0.15,
    cv_folds: int = 0,
    seed: int = 42,
    labels: Sequence[str] = domain.LABELS,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Pick settings by macro F1 on held-out rows or folds, fit again on all
    development rows, judge once on the test rows.

    Takes ``message`` and ``class``; gives the model, the trials and the scored test rows.
    """
    configs = [{**DEFAULTS, **c} for c in configs]
    ready = df.withColumn("label", label_id("class", labels).cast("double")).where(F.col("label").isNotNull())
    # Groups and sides are written once each: every fit goes over its rows several times.
    parts = checkpointed(splits.split_with_fallback(splits.with_groups(ready), test_size, seed, has_groups=True))
    dev = parts.where(F.col("split") == "train").drop("split")
    test = parts.where(F.col("split") == "heldout")
    if cv_folds:
        folded = checkpointed(splits.group_kfold(dev, cv_folds, seed, has_groups=True))
        pairs = [(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)) for f in range(cv_folds)]
    else:
        inner = checkpointed(splits.split_with_fallback(dev, val_size / (1.0 - test_size), seed, has_groups=True))
        pairs = [(inner.where(F.col("split") == "train"), inner.where(F.col("split") == "heldout"))]
    trials = quality.cv_average(run_trials(df, configs, pairs, labels), ("macro_f1", "weighted_f1", "accuracy"))
    best = quality.select_trial(trials).first()
    model = text_pipeline(configs[best["trial_index"] - 1]).fit(dev)
    return model, trials, predicted_labels(model, test, labels)
