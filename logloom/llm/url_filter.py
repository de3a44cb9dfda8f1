"""URL filter by link-graph propagation, with DataFrame functions only.

Rules judge what they fit. All other URLs are judged by their host: trust flows from hosts with allowed
pages along host edges (personalised PageRank), and distrust flows against the edges from hosts with
blocked pages, so a host that links to blocked ones is distrusted. A host is blocked where its distrust is
more than ``threshold`` times its trust. Both are followed until no more than ``tolerance`` of them still
moves, and what flows into hosts without further edges goes back to the seeds, so both sum to 1.

Host edges are the hyperlinks between hosts of the pages' ``href`` attributes, counted, and for every host
below another one an edge each way between it and the domain it is part of. Edges are summed before any
join; ranks are salted copies joined with the edges, so a host with any number of links is spread.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed. A null or empty page has no links. Repeated rows are judged alike and count as pages of their
own. A host that neither trust nor distrust reaches is allowed. Without seeds no host is blocked by the
method. Only the id, URL and page columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import checkpointed, no_text, salted_join

#: (verdict, host, path) of each rule; a rule fits its host and all subdomains where the path starts with its own.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Steps between two looks at the change of the ranks, and what may still change in them, as a share of all rank.
STEPS, TOLERANCE = 8, 1e-6
DAMPING, THRESHOLD = 0.85, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^"'\s/?#>]+)"""


def host(url: str | Column) -> Column:
    """After the first ``://`` up to the next ``/``, ``?`` or ``#``, A-Z lowered; empty without ``://``."""
    return F.translate(F.regexp_extract(no_text(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(no_text(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host_: Column, path_: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later ones win
        fits = ((host_ == of) | F.endswith(host_, F.lit("." + of))) & F.startswith(path_, F.lit(start))
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b, weight): links of host a to host b, and steps between a host and the domain it is part of."""
    linked = pages.select(host(url).alias("a"), F.explode(F.regexp_extract_all(no_text(html), F.lit(HREF), F.lit(1))).alias("b"))
    linked = linked.withColumn("b", F.translate("b", UPPER, LOWER)).where("a <> '' AND b <> '' AND a <> b")
    links = linked.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select(host(url).alias("host")).union(links.select("b")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    up = hosts.select(labels.alias("l")).where("size(l) > 2").select("l", F.explode(F.expr("sequence(1, size(l) - 2)")).alias("n"))
    part = lambda n: F.array_join(F.slice("l", n, F.size("l")), ".")
    steps = up.select(part(F.col("n")).alias("a"), part(F.col("n") + 1).alias("b")).distinct()
    steps = steps.union(steps.select("b", "a")).withColumn("weight", F.lit(1.0))
    return links.union(steps).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): PageRank that returns to the seeds (kind, host, weight) over edges (kind, a, b, weight), each kind by itself.

    The ranks grow from the seeds' own part, so their summed change is the growth of their sum. Giving the
    mass of hosts without further edges back to the seeds is the same as raising all ranks by one factor,
    until they sum to 1; that is done at the end.
    """

    def by_kind(table: DataFrame, column: str) -> dict[str, float]:
        return {r["kind"]: r["total"] for r in table.groupBy("kind").agg(F.sum(column).alias("total")).collect()}

    def share(column: str, totals: dict[str, float]) -> Column:
        of = F.lit(None).cast("double")
        for kind, total in totals.items():
            of = F.when(F.col("kind") == kind, F.lit(total)).otherwise(of)
        return F.col(column) / of

    start = checkpointed(seeds.select("kind", "host", ((1 - damping) * share("weight", by_kind(seeds, "weight"))).alias("rank")))
    out = edges.groupBy("kind", "a").agg(F.sum("weight").alias("out"))
    shares = checkpointed(salted_join(edges, out, ["kind", "a"], ["b"]).select("kind", "a", "b", (F.col("weight") / F.col("out")).alias("share")))
    rank, totals = start, by_kind(start, "rank")
    while True:
        for _ in range(STEPS):
            flow = salted_join(shares, rank.withColumnRenamed("host", "a"), ["kind", "a"], ["b"])
            flow = flow.select("kind", F.col("b").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            rank = flow.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = checkpointed(rank)
        before, totals = totals, by_kind(rank, "rank")
        if all(total - before[kind] <= tolerance * total for kind, total in totals.items()):
            return rank.select("kind", "host", share("rank", totals).alias("rank"))


def judged(
    pages: DataFrame, rules: Sequence[Rule] = RULES, tolerance: float = TOLERANCE, damping: float = DAMPING, threshold: float = THRESHOLD,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict."""
    rows = pages.select(F.col(page_id).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = checkpointed(rows.withColumn("rule", rule).withColumn("known", verdict))
    edges = checkpointed(host_edges(pages, url, html))
    seeds = rows.where("known IS NOT NULL AND host <> ''").groupBy("host", "known").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = edges.select(F.lit("allow").alias("kind"), "a", "b", "weight").union(edges.select(F.lit("block"), "b", "a", "weight"))
    ranks = propagated(both, seeds.withColumnRenamed("known", "kind"), damping, tolerance)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    bad = ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    bad = checkpointed(bad.where(F.col("distrust") > threshold * F.col("trust") + 1e-12).select("host", F.lit("block").alias("found")))
    named = salted_join(rows, bad, ["host"], ["page_id"], "left")
    return named.select("page_id", "host", "path", "rule", F.coalesce("known", "found", F.lit("allow")).alias("verdict"))
