"""Mixing sources to target weights: budgets through a tree of domains, languages and sources.

The token budget is dealt from the root down. At each node the children get shares by weight; a child
that has fewer tokens than its share takes what it has and its shortage goes to its siblings by weight.
Only what no child of a node can take was never given to that node, because a node's capacity is what its
leaves hold; so shortages move among siblings before they reach the node above.

A leaf takes its budget from seeded epochs: whole epochs first, then the documents of the next epoch in
seeded order as long as at least half of each fits, so that leaves of few documents miss their budgets by
chance only. The order is a hash of seed, epoch and id. The running
sums are built per leaf and hash range and only the range in which the budget ends is looked at by key,
so a leaf of any size is spread over all tasks.

Defined results: null domain, language or source is a node named ''. A missing weight is 1, a weight of 0
gets nothing. Rows of one leaf and id are taken or left together; a null id counts as one id. A document without tokens
is taken with the epoch or prefix it lies in. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import checkpointed, no_text, salted_join

LEAF = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(no_text(text), F.lit(WORD)).cast("long")


def _filled(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Column ``given``: the part of ``budget`` (of the parent) that each child gets, from ``held`` and ``weight``.

    Children are taken by how soon they are full; the first that is not full sets the level for the rest.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("held") / F.col("weight"), name)
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(rest))
    level = left.withColumn("full", F.expr("held * weights <= left * weight"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("held") / F.col("weight"), F.col(name), F.col("left"), F.col("weights")))).over(Window.partitionBy(*parent))
    level = level.withColumn("first", first)
    share = F.expr("CASE WHEN full THEN held ELSE greatest(first.left, 0L) * weight DIV first.weights END")
    return level.withColumn("given", F.least(share, F.col("held"))).drop("left", "weights", "full", "first")


def _weight(table: Mapping[str, int], name: str) -> Column:
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col(name)], F.lit(1)).cast("long") if pairs else F.lit(1).cast("long")


def leaf_plans(leaves: DataFrame, share: tuple[int, int], epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): budget, whole epochs and tokens of the next epoch.

    The whole budget is ``share`` (parts, of) of all tokens; each leaf can give ``epochs`` times its tokens.
    """
    for name in LEAF:
        leaves = leaves.withColumn(f"{name}_weight", _weight(weights.get(name, {}), name))
    leaves = leaves.where("domain_weight > 0 AND lang_weight > 0 AND source_weight > 0").withColumn("held", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.expr(f"sum(tokens) * {share[0]} DIV {share[1]}"), F.lit(0)).alias("budget")).withColumn("root", F.lit(0))
    langs = leaves.groupBy("domain", "lang", "domain_weight", "lang_weight").agg(F.sum("held").alias("held"))
    domains = langs.groupBy("domain", "domain_weight").agg(F.sum("held").alias("held"))
    top = domains.withColumn("root", F.lit(0)).join(total, "root").withColumn("weight", F.col("domain_weight"))
    top = _filled(top, ("root",), "domain").select("domain", F.col("given").alias("budget"))
    middle = langs.join(top, "domain").withColumn("weight", F.col("lang_weight"))
    middle = _filled(middle, ("domain",), "lang").select("domain", "lang", F.col("given").alias("budget"))
    low = leaves.join(middle, ["domain", "lang"]).withColumn("weight", F.col("source_weight"))
    low = _filled(low, ("domain", "lang"), "source")
    whole = F.expr("CASE WHEN tokens > 0 THEN given DIV tokens ELSE 0 END")
    return low.select(*LEAF, F.col("given").alias("budget"), whole.alias("whole"), (F.col("given") - whole * F.col("tokens")).alias("rest"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def leaf_cuts(rows: DataFrame, share: tuple[int, int], epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int, digits: int) -> DataFrame:
    """Per leaf: whole epochs, and the last key (``cut``) that the next epoch's prefix takes; null takes none.

    ``16 ** digits`` hash ranges per leaf share out the running sums.
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    plans = checkpointed(leaf_plans(leaves, share, epochs, weights))
    placed = salted_join(rows, plans.drop("budget").where("rest > 0"), LEAF, ["doc_id"])
    placed = checkpointed(placed.select(*LEAF, "tokens", "rest", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key")))
    ranged = placed.withColumn("range", F.substring("key", 1, digits))
    by = Window.partitionBy(*LEAF).orderBy("range")
    ranges = ranged.groupBy(*LEAF, "rest", "range").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(by))
    last_range = checkpointed(ranges.where("upto - tokens <= rest AND upto > rest").select(*LEAF, "range", F.expr("upto - tokens AS before")))
    inside = salted_join(ranged, last_range, [*LEAF, "range"], ["key"])
    keys = inside.groupBy(*LEAF, "before", "rest", "key").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key")) + F.col("before")
    last = keys.withColumn("run", run).where("2 * run - tokens <= 2 * rest").groupBy(*LEAF).agg(F.max("key").alias("last"))
    cut = last_range.join(last, list(LEAF), "left").select(*LEAF, F.coalesce("last", "range").alias("cut"))
    return checkpointed(plans.select(*LEAF, "whole").join(cut, list(LEAF), "left"))


def _leaf_rows(docs: DataFrame, domain: Column, tokens: Column, doc_id: str, lang: str, source: str) -> DataFrame:
    names = {"domain": domain, "lang": F.col(lang), "source": F.col(source)}
    return docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id"), *[no_text(c).alias(n) for n, c in names.items()], tokens.alias("tokens"))


def _times(seed: int) -> Column:
    whole = F.coalesce("whole", F.lit(0))
    return (whole + F.coalesce((order_key(seed, whole, F.col("doc_id")) <= F.col("cut")).cast("long"), F.lit(0))).cast("long")


def copies(
    docs: DataFrame, domain: Column, tokens: Column, share: tuple[int, int], epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int = 1,
    doc_id: str = "doc_id", lang: str = "lang", source: str = "source", digits: int = 3,
) -> DataFrame:
    """Per document: doc_id, domain, lang, source, tokens, copies (how often it is taken, 0 for never)."""
    rows = checkpointed(_leaf_rows(docs, domain, tokens, doc_id, lang, source).drop("doc"))
    cuts = leaf_cuts(rows, share, epochs, weights, seed, digits)
    return salted_join(rows, cuts, LEAF, ["doc_id"], "left").select("doc_id", *LEAF, "tokens", _times(seed).alias("copies"))


def mixed(
    docs: DataFrame, domain: Column, tokens: Column, share: tuple[int, int], epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int = 1,
    doc_id: str = "doc_id", lang: str = "lang", source: str = "source", digits: int = 3,
) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    rows = _leaf_rows(docs, domain, tokens, doc_id, lang, source)
    cuts = leaf_cuts(checkpointed(rows.drop("doc")), share, epochs, weights, seed, digits)
    taken = salted_join(rows.drop("tokens"), cuts, LEAF, ["doc_id"], "left").withColumn("copies", _times(seed)).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
