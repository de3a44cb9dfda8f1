"""Bulk labelling by an outside service, in batches, and alignment of its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom import domain
from logloom.functions.text import strip
from logloom.operators.indexing import into_batches, with_order_index
from logloom.session import checkpointed
from logloom.sources.sinks import table_or_none

Client = Callable[[list[str]], Mapping[str, object]]
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
ANSWER = "content string, " + ", ".join(f"{n} bigint" for n in USAGE)
RESPONSE = f"batch_id bigint, {ANSWER}"


class RateLimited(Exception):
    """Raised by a client that is asked to wait."""


def answer_at(content: Column, pos: Column) -> Column:
    """The class at a position of an answer, or null."""
    results = F.from_json(F.get_json_object(content, "$.results"), "array<string>")
    return F.get_json_object(F.get(results, pos), "$.class")


def align_labels(batches: DataFrame, responses: DataFrame, default: str = domain.DEFAULT_LABEL) -> DataFrame:
    """Give row ``pos`` of each batch the answer at that place; no answer is the default label."""
    label = F.coalesce(answer_at(F.col("content"), F.col("pos")), F.lit(default))
    return batches.join(responses.select("batch_id", "content"), "batch_id", "left").select(*batches.columns, label.alias("class"))


def prompt_case_eval(cases: DataFrame, responses: DataFrame, default: str = domain.DEFAULT_LABEL) -> DataFrame:
    """Expected against given answers by position; an empty answer is the default label."""
    got = strip(answer_at(F.col("content"), F.col("pos")))
    got = F.when(got == "", F.lit(default)).otherwise(got)
    name = F.when(strip("name") == "", F.concat(F.lit("Case "), F.col("pos") + 1)).otherwise(strip("name"))
    joined = cases.join(responses.select("batch_id", "content"), "batch_id", "left")
    return joined.select(
        "batch_id", "pos", name.alias("name"), strip("message").alias("message"), strip("expected").alias("expected"),
        got.alias("got"), (strip("expected") == got).alias("match"),
    )


def usage_totals(responses: DataFrame) -> DataFrame:
    """Sums of the token counts; a missing count is 0."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return responses.agg(*[F.coalesce(F.sum(F.coalesce(F.col(n).cast("bigint"), F.lit(0))), F.lit(0)).alias(n) for n in names])


def ask_with_patience(client: Client, messages: list[str], attempts: int, first_wait: float) -> Mapping[str, object]:
    for attempt in range(attempts):
        try:
            return client(messages)
        except RateLimited:
            time.sleep(first_wait * 2**attempt)
    raise RuntimeError("the labelling service kept asking to wait")


def call_client(batches: DataFrame, client: Client, attempts: int = 5, first_wait: float = 5.0) -> DataFrame:
    """One call per batch. Batches are spread over the partitions: as many callers as partitions."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for batch_id, messages in zip(frame["batch_id"], frame["messages"]):
                answer = ask_with_patience(client, list(messages), attempts, first_wait)
                usage = [int(answer.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
                rows.append((batch_id, answer.get("content"), *usage))
            yield pd.DataFrame(rows, columns=["batch_id", "content", "prompt_tokens", "completion_tokens", "total_tokens"])

    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"])
    gathered = batches.groupBy("batch_id").agg(rows.alias("messages"))
    return gathered.mapInPandas(call, RESPONSE)


def label_rows(df: DataFrame, client: Client, order: Sequence[str], size: int = 10, attempts: int = 5, first_wait: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Label all rows of ``df`` (column ``message``) in consecutive batches.

    Gives the labelled rows and the usage totals. The answers are written to
    the shared folder before use, so each batch is paid for once.
    """
    batches = into_batches(with_order_index(df, order), size=size)
    responses = checkpointed(call_client(batches, client, attempts, first_wait))
    return align_labels(batches, responses), usage_totals(responses)


class LabellingStopped(RuntimeError):
    """Some batches got no answer; the answers that came are in the ledger, and the next run asks for the others only."""


def _asked(client: Client, attempts: int, first_wait: float):
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, messages in zip(frame["batch_key"], frame["messages"], strict=True):
                try:
                    answer = ask_with_patience(client, list(messages), attempts, first_wait)
                    usage = [int(answer.get(k) or 0) for k in USAGE]
                    rows.append((key, answer.get("content"), *usage, None))
                except Exception as fault:  # noqa: BLE001  any fault of a client is one of its batch
                    rows.append((key, None, 0, 0, 0, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["batch_key", "content", *USAGE, "error"])

    return call


def label_rows_with_ledger(
    df: DataFrame, client: Client, order: Sequence[str], ledger: str, size: int = 10, attempts: int = 5, first_wait: float = 5.0, wave: int = 10_000, callers: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """As ``label_rows``, with all answers kept in ``ledger``: labelled rows, and what the run's own calls used.

    Batches are named by their messages; one that the ledger holds is not asked for again, in this run or a later one.
    They are asked for in waves, and each wave's answers are committed to the ledger before the next begins, so a lost
    executor costs its part of one wave. A client that fails for some batches does not lose the others: their answers are
    kept, and ``LabellingStopped`` is raised at the end of the wave. ``callers`` bounds the calls at one time over all executors.
    """
    spark = df.sparkSession
    batches = checkpointed(into_batches(with_order_index(df, order), size=size))
    messages = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: F.coalesce(x["message"], F.lit("")))
    key = F.sha2(F.to_json(F.col("messages")), 256).alias("batch_key")
    gathered = checkpointed(batches.groupBy("batch_id").agg(messages.alias("messages")).select("batch_id", key, "messages"))
    known = table_or_none(spark, ledger)
    open_ = gathered.select("batch_key", "messages").dropDuplicates(["batch_key"])
    open_ = checkpointed(open_ if known is None else open_.join(known.select("batch_key"), "batch_key", "left_anti"))
    waves = max(-(-open_.count() // wave), 1)
    used = []
    for n in range(waves):
        part = open_.where(F.pmod(F.xxhash64("batch_key"), F.lit(waves)) == n)
        answers = checkpointed((part.repartition(callers) if callers else part).mapInPandas(_asked(client, attempts, first_wait), f"batch_key string, {ANSWER}, error string"))
        answers.where("error IS NULL").drop("error").write.mode("append").parquet(ledger)
        used.append(answers)
        failed = answers.where("error IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error")).first()
        if failed["n"]:
            raise LabellingStopped(f"{failed['n']} batches got no answer: {failed['error']}")
    responses = gathered.select("batch_id", "batch_key").join(table_or_none(spark, ledger).dropDuplicates(["batch_key"]), "batch_key").drop("batch_key")
    return align_labels(batches, responses), usage_totals(reduce(DataFrame.unionByName, used))
