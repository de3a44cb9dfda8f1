"""From documents to packed sequences: language, near copies, secrets, mixture, packing.

Each stage reads the written result of the one before and returns the columns of ``documents``, the last
one the pieces of the sequences. Stages keep a document's columns in one struct where they add some of their own, so
columns of any name may stand beside them. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import langid, minhash, mixing, packing, queries, secret_scan
from logloom.llm.common import checkpointed, given
from logloom.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, no letter) go; ``lang`` becomes the predicted one.

    Where no language could be learned, all documents stay as they are.
    """
    ship_package(spark)
    samples = langid.learned_from(docs)
    if not samples:
        return docs
    found = langid.judged(docs, samples).where(f"verdict.lang_pred <> '{langid.UNDETERMINED}'")
    return found.select(F.col("doc").withField("lang", F.col("verdict.lang_pred")).alias("doc")).select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    The least id stays, a null one only where there is no other; of repeated rows one stays. Documents without words or text all stay.
    """
    ship_package(spark)
    return minhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and ``n_chars`` follows. A null text stays null and has a null ``n_chars``."""
    ship_package(spark)
    found = docs.select(F.struct("*").alias("doc"), secret_scan.find("text").alias("found"))
    clean = found.select("doc", secret_scan.redacted("doc.text", F.col("found")).alias("clean"))
    return clean.select(F.col("doc").withField("text", F.col("clean")).withField("n_chars", F.length("clean").cast("long")).alias("doc")).select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens by the weights of domains, languages and sources; a row comes once for each epoch that takes it."""
    ship_package(spark)
    return mixing.mixed(docs, F.expr(queries.DOMAIN), mixing.word_count("text"), queries.SHARE, queries.EPOCHS, queries.MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences. A null or empty text is the closing id alone, and each repeated row is a document of its own."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
