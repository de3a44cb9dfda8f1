"""Versions, inventories and lineage records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import line_count, strip, text_sha256
from logloom.operators.indexing import with_order_index
from logloom.operators.skew import spread_join


def content_versions(df: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """One row per distinct text (per key): hash as id, the first time it was seen, its size."""
    keys = [key] if key else []
    return df.groupBy(*keys, text_sha256(text).alias("version_id")).agg(
        F.min("created_at").alias("created_at"), F.first(text).alias("text")
    ).select(
        *keys, "version_id", F.substring("version_id", 1, 12).alias("version_label"), "created_at", "text",
        F.length("text").alias("char_count"), line_count("text").cast("bigint").alias("line_count"),
    )


def version_history(versions: DataFrame, key: str | None = None) -> DataFrame:
    """Versions with their predecessor by time and id.

    The order is a dense index, and the predecessor is found by joining on
    index - 1, so one long history is spread over many tasks.
    """
    keys = [key] if key else []
    lean = versions.drop("text")
    ordered = with_order_index(lean, ["created_at", "version_id"], keys, "position")
    earlier = ordered.select(*keys, (F.col("position") + 1).alias("position"), F.col("version_id").alias("previous_version_id"))
    return ordered.join(earlier, [*keys, "position"], "left").withColumn(
        "previous_version_id", F.coalesce("previous_version_id", F.lit(""))
    )


def version_diffs(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Lines of each version against its predecessor: ``change`` is how often a line was added, or below 0 removed.

    Lines are counted once per version; two versions meet by line, so texts of
    any length are spread over tasks.
    """
    texts = versions.groupBy("version_id").agg(F.first("text").alias("text"))
    lines = texts.select("version_id", F.explode(F.split("text", r"\r\n|[\n\r]")).alias("line")).groupBy("version_id", "line").agg(F.count(F.lit(1)).alias("n"))
    # A common first version is the predecessor in many histories: each pair is compared once, hot versions are spread.
    asked = history.where(F.col("previous_version_id") != "").select("version_id", "previous_version_id").distinct()
    new = spread_join(lines, asked.groupBy("version_id").agg(F.collect_set("previous_version_id").alias("of")), ["version_id"])
    new = new.select("version_id", F.explode("of").alias("previous_version_id"), "line", "n")
    before = lines.withColumnRenamed("version_id", "previous_version_id")
    old = spread_join(asked, before.groupBy("previous_version_id").agg(F.collect_list(F.struct("line", "n")).alias("lines")), ["previous_version_id"])
    old = old.select("version_id", "previous_version_id", F.explode("lines").alias("l")).select("version_id", "previous_version_id", "l.line", (-F.col("l.n")).alias("n"))
    changed = new.unionByName(old).groupBy("version_id", "previous_version_id", "line").agg(F.sum("n").alias("change"))
    return changed.where("change <> 0")


def latest_report(history: DataFrame, keys: Sequence[str], order: Sequence[str] = ("created_at", "report_id")) -> DataFrame:
    """The newest row of each key, by partial maxima."""
    return history.groupBy(*keys).agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("row")).select("row.*")


def model_inventory(models: DataFrame, sources: Sequence[str] = ("Latest local", "Archived", "Downloaded", "Selected")) -> DataFrame:
    """One row per path, from the first source that has it; newest first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    chosen = F.min_by(F.struct(*models.columns), F.struct(F.when(rank > 0, rank).otherwise(len(sources) + 1), F.col("created_at").cast("string"), "model_version_id"))
    return (
        models.groupBy(F.col("path").alias("__path")).agg(chosen.alias("row")).select("row.*")
        .orderBy(F.desc("created_at"), F.desc("model_version_id"), F.desc("path"))
    )


def _prefix_key(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def resolve_versions(requests: DataFrame, versions: DataFrame, prefix: str = "prefix", key_chars: int = 4) -> DataFrame:
    """For each asked prefix: the version it names, or none, or that it is ambiguous.

    Joined on the first ``key_chars`` characters; shorter prefixes meet the
    shorter keys of the same versions, so any length is exact.
    """
    ids = versions.select("version_id", "created_at").distinct()
    keyed = ids.withColumn("__key", F.explode(F.array_distinct(F.array(*[_prefix_key(F.col("version_id"), n) for n in range(1, key_chars + 1)]))))
    asked = requests.select(prefix).distinct().withColumn("__key", F.substring(prefix, 1, key_chars))
    found = asked.join(keyed, "__key").where(F.col("version_id").startswith(F.col(prefix))).groupBy(prefix).agg(
        F.count(F.lit(1)).alias("matches"), F.max_by("version_id", F.struct("created_at", "version_id")).alias("last"),
        F.bool_or(F.col("version_id") == F.col(prefix)).alias("exact"),
    )
    matches = F.coalesce("matches", F.lit(0))
    status = F.when(matches == 0, "not_found").when((matches > 1) & ~F.col("exact"), "ambiguous").otherwise("found")
    return requests.join(found, prefix, "left").select(
        *requests.columns, matches.alias("matches"), status.alias("status"), F.when(status == "found", F.col("last")).alias("version_id")
    )


def resolve_version(versions: DataFrame, prefix: str) -> str:
    """The id of the one version that starts with ``prefix``; an error if none or several do."""
    asked = versions.sparkSession.createDataFrame([(prefix,)], "prefix string")
    row = resolve_versions(asked, versions).first()
    if row["status"] != "found":
        raise ValueError(f"version {prefix!r} is {row['status'].replace('_', ' ')}")
    return row["version_id"]


def new_versions(incoming: DataFrame, existing: DataFrame, key: str = "version_id") -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


# Fields of a lineage record that a later step takes over as they are.
LINEAGE_FIELDS = (
    "data_prep_run_id", "prompt_hash", "input_dataset_hash", "output_dataset_hash", "llm_model", "prompt_version_id",
    "prompt_version_label", "prompt_version_dir", "prompt_version_path", "prompt_metadata_path",
    "prompt_comparison_path", "previous_prompt_version_id", "data_version_id", "data_version_dir", "data_version_path",
)


def _filled(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist, else empty text."""
    present = [F.nullif(strip(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(""))


def lineage_resolve(datasets: DataFrame, sidecars: DataFrame, tracking_uri: str = "", experiment_name: str = "", enabled: bool = True) -> DataFrame:
    """Context of a training run for each data set from its lineage record.

    The parent run is dropped when the record was made for another tracking
    target. A missing pipeline id becomes the hash of the data set's id.
    """
    rows = datasets.join(sidecars, "dataset_id", "left")

    def other(recorded: Column, current: str) -> Column:
        return (recorded != "") & F.lit(bool(current)) & (recorded != current)

    recorded_uri = _filled(rows, "training_tracking_uri", "tracking_uri", "data_prep_tracking_uri")
    recorded_name = _filled(rows, "training_experiment_name", "experiment_name", "data_prep_experiment_name")
    stale = F.lit(enabled) & (other(recorded_uri, tracking_uri) | other(recorded_name, experiment_name))
    pipeline = _filled(rows, "pipeline_id")
    return rows.select(
        "dataset_id",
        F.when(pipeline == "", F.sha2(F.col("dataset_id").cast("string"), 256)).otherwise(pipeline).alias("pipeline_id"),
        F.when(stale, "").otherwise(_filled(rows, "parent_run_id")).alias("parent_run_id"),
        *[_filled(rows, f).alias(f) for f in LINEAGE_FIELDS],
        _filled(rows, "data_prep_tracking_uri", "tracking_uri").alias("data_prep_tracking_uri"),
        _filled(rows, "data_prep_experiment_name", "experiment_name").alias("data_prep_experiment_name"),
    )
