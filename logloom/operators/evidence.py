"""Ranking commits against the evidence in error events.

All look-ups depend only on an event's *signature*: repository, branch,
commit ids, look-back day, source paths and search terms. Events are reduced
to their distinct signatures first, so a message that makes up a third of all
events is looked up once, and the verdict is joined back at the end.

Tables
    commits  repo, branch, sha, parent_sha, message, author_name,
             author_email, author_login, authored_at, committed_at
    files    repo, sha, position, filename, patch
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom import domain
from logloom.functions import payload as payloads, text as texts
from logloom.operators.indexing import with_order_index
from logloom.operators.skew import spread_join, top_rows
from logloom.session import checkpointed

#: Terms that one copy of a patch is searched for.
TERMS_AT_ONCE = 500
SIGNATURE = ("repo", "branch", "commit_sha", "previous_sha", "since", "paths", "terms")
LISTS = (  # kind of evidence, output list, cap
    ("path", "matched_source_paths", 8),
    ("file", "matched_files", 8),
    ("term_diff", "matched_terms_in_diff", 12),
    ("term_file", "matched_terms_in_changed_files", 12),
    ("snippet", "diff_snippets", 5),
)


def of_any_branch(commits: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The commits of each branch, and all of a repository once more under the branch '' of events that name none.

    ``asked`` (with ``repo, branch``) leaves the second part out for repositories in which every event names its branch.
    """
    anywhere = commits
    if asked is not None:
        anywhere = commits.join(checkpointed(asked.where("branch = ''").select("repo").distinct()), "repo", "left_semi")
    anywhere = anywhere.dropDuplicates(["repo", "sha"]).withColumn("branch", F.lit(""))
    return commits.where("branch <> ''").unionByName(anywhere.select(*commits.columns))


def newest_first() -> list[Column]:
    return [F.col("committed_at").desc(), F.col("sha").desc()]


def _that_may_meet(df: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key may be one of ``few``, told by 8-byte hashes; the join that follows is exact.

    The hashes are written first, so their size is known and Spark sends them to all tasks as long as its limit
    allows: rows that meet nothing are then dropped where they are read, and not shuffled.
    """
    keys = checkpointed(few.select(F.xxhash64(*on).alias("__key")).distinct())
    return df.withColumn("__key", F.xxhash64(*on)).join(keys, "__key", "left_semi").drop("__key")


def event_signatures(events: DataFrame, repo: str, default_branch: str = "", lookback_days: int = 14, payload_chars: int | None = None) -> DataFrame:
    """Events (``event_id, received_at, payload``) with what their evidence is looked up by."""
    raw = F.col("payload")
    key_lists = [domain.BRANCH_KEYS, domain.EVENT_TIME_KEYS, domain.COMMIT_SHA_KEYS, domain.PREVIOUS_SHA_KEYS, domain.SOURCE_PATH_KEYS]
    # The payload is parsed once, and each step is a column, so that what is used several times is worked out once.
    step = events.withColumn("__top", payloads.payload_map(raw))
    step = step.withColumns({"message": payloads.message_of(F.col("__top"), raw), "__found": payloads.nested_values(F.col("__top"), key_lists)}).drop("__top")
    found_branch, found_time, found_sha, found_previous, found_path = (F.col("__found")[i] for i in range(len(key_lists)))
    branch = texts.clean_branch(found_branch)
    stamp = F.coalesce(texts.parse_utc(found_time), F.col("received_at").cast("timestamp"))
    step = step.select(
        *[c for c in step.columns if c != "__found"],
        F.lit(repo).alias("repo"),
        F.when(branch == "", F.lit(default_branch)).otherwise(branch).alias("branch"),
        F.lower(texts.commit_sha(found_sha)).alias("commit_sha"),
        F.lower(texts.commit_sha(found_previous)).alias("previous_sha"),
        texts.lookback_date(stamp, lookback_days).alias("since"),
        texts.source_paths(found_path, "message", raw).alias("paths"),
    )
    step = step.withColumn("terms", texts.evidence_terms("message", raw, F.col("paths"), payload_chars=payload_chars))
    return step.withColumn("sig_id", F.md5(F.to_json(F.struct(*SIGNATURE)).cast("binary")))


def distinct_signatures(signed: DataFrame) -> DataFrame:
    """One row per signature; equal events are merged before the shuffle."""
    return signed.groupBy("sig_id").agg(*[F.first(c).alias(c) for c in SIGNATURE])


def branch_history(commits: DataFrame, limit: int = 10) -> DataFrame:
    """Latest commits of each branch with the commit each one is compared to."""
    newest = top_rows(commits.select("repo", "branch", "sha", "parent_sha", "committed_at"), ["repo", "branch"], newest_first(), limit + 1, "history_rank")
    # The window below sees at most limit + 1 rows per branch.
    older = F.lead("sha").over(Window.partitionBy("repo", "branch").orderBy("history_rank"))
    base = F.coalesce(F.nullif(F.col("parent_sha"), F.lit("")), older)
    return newest.withColumn("base_sha", base).where(F.col("history_rank") <= limit).drop("parent_sha")


def consecutive_commits(signatures: DataFrame, commits: DataFrame, limit: int = 10) -> DataFrame:
    """The latest commits of each branch that have a base to compare to, also over all branches where signatures name none."""
    limit = min(max(limit, 1), 25)
    return branch_history(of_any_branch(commits, signatures), limit).where(F.col("base_sha").isNotNull()).select("repo", "branch", "sha", "base_sha", "history_rank")


def consecutive_pairs(signatures: DataFrame, commits: DataFrame, limit: int = 10) -> DataFrame:
    """Each signature with the latest commits of its branch that have a base to compare to."""
    return spread_join(signatures.select("sig_id", "repo", "branch", "paths", "terms"), consecutive_commits(signatures, commits, limit), ["repo", "branch"])


def _by_sha(signatures: DataFrame, commits: DataFrame, asked: str, keep: Sequence[str]) -> DataFrame:
    """Signatures with the commits that a full or short sha names."""
    key = F.substring(asked, 1, 7).alias("sha7")
    wanted = signatures.where(F.col(asked) != "").select("sig_id", "repo", F.col(asked).alias("asked"), key)
    known = _that_may_meet(commits.select("repo", F.substring("sha", 1, 7).alias("sha7"), *keep), wanted, ["repo", "sha7"])
    return spread_join(wanted, known, ["repo", "sha7"]).where(F.col("sha").startswith(F.col("asked"))).drop("asked", "sha7")


def candidates_by_sha(signatures: DataFrame, commits: DataFrame) -> DataFrame:
    return _by_sha(signatures, commits, "commit_sha", ["sha"]).select("sig_id", "sha").distinct()


def with_branch_position(commits: DataFrame) -> DataFrame:
    """Dense position of each commit in its branch, oldest first."""
    if "position" in commits.columns:
        return commits
    return with_order_index(commits.select("repo", "branch", "sha", "committed_at"), ["committed_at", "sha"], ["repo", "branch"], "position")


def candidates_by_range(signatures: DataFrame, commits: DataFrame, last: int = 5) -> DataFrame:
    """The last commits after the previous and up to the payload's commit, on the same branch.

    Positions are dense, so the wanted ones are written out and joined by equality.
    """
    placed = with_branch_position(commits)
    both = signatures.where((F.col("commit_sha") != "") & (F.col("previous_sha") != ""))
    keep = ["branch", "sha", "position"]
    head = _by_sha(both, placed, "commit_sha", keep).withColumnsRenamed({"position": "head"}).drop("sha")
    tail = _by_sha(both, placed, "previous_sha", keep).withColumnsRenamed({"position": "tail"}).drop("sha")
    spans = head.join(tail, ["sig_id", "repo", "branch"]).where(F.col("tail") < F.col("head"))
    first = F.greatest(F.col("tail") + 1, F.col("head") - (last - 1))
    wanted = spans.withColumn("position", F.explode(F.sequence(first, F.col("head"))))
    found = spread_join(wanted.select("sig_id", "repo", "branch", "position"), placed.select("repo", "branch", "position", "sha"), ["repo", "branch", "position"])
    return found.select("sig_id", "sha").distinct()


def candidates_by_path(signatures: DataFrame, commits: DataFrame, files: DataFrame, paths: int = 5, per_path: int = 3) -> DataFrame:
    """Latest commits that changed one of the first paths, on the signature's branch.

    The latest commits of each path are found once per path, not per event.
    """
    asked = signatures.select("sig_id", "repo", "branch", F.posexplode(F.slice("paths", 1, paths)).alias("path_at", "path"))
    clean = F.btrim(F.replace("filename", F.lit("\\"), F.lit("/")), F.lit("/"))
    wanted = checkpointed(asked.select("repo", "branch", "path").distinct())
    touched = files.select("repo", "sha", clean.alias("path")).join(wanted.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    # Dealt by commit at once, for the distinct rows and for the join with the commits.
    touched = touched.repartition("repo", "sha").distinct()
    dated = touched.join(of_any_branch(commits.select("repo", "branch", "sha", "committed_at"), wanted), ["repo", "sha"])
    latest = top_rows(dated, ["repo", "branch", "path"], newest_first(), per_path)
    hits = spread_join(asked, latest.select("repo", "branch", "path", "sha"), ["repo", "branch", "path"])
    return hits.select("sig_id", "sha", "path_at", "path")


def _tokens(message: Column) -> Column:
    words = F.regexp_extract_all(F.lower(message), F.lit(r"([a-z0-9_.-]+)"), 1)
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit("._-"))), lambda w: w != ""))


def commit_search(queries: DataFrame, commits: DataFrame, hits: int = 5) -> DataFrame:
    """For each query (``repo, query_id, words``) the latest commits whose message has all words.

    An inverted index is built over the words asked for. A query meets only
    the commits of its rarest word, and single-word queries only the newest
    ``hits`` commits of that word, cut to that number before the shuffle.
    """
    asked = queries.select("repo", "query_id", "words", F.explode("words").alias("word"))
    vocabulary = asked.select("repo", "word").distinct()
    messages = commits.select("repo", "sha", "committed_at", "message").dropDuplicates(["repo", "sha"])
    words = messages.select("repo", "sha", "committed_at", F.explode(_tokens(F.col("message"))).alias("word"))
    found = checkpointed(words.join(vocabulary, ["repo", "word"], "left_semi"))
    documents = found.groupBy("repo", "sha", "committed_at").agg(F.collect_set("word").alias("has"))
    postings = documents.withColumn("word", F.explode("has"))
    sizes = found.groupBy("repo", "word").agg(F.count(F.lit(1)).alias("size"))
    rarest = (
        asked.join(sizes, ["repo", "word"], "left")
        .groupBy("repo", "query_id")
        .agg(F.first("words").alias("words"), F.min(F.coalesce("size", F.lit(0))).alias("size"), F.min_by("word", F.struct(F.coalesce("size", F.lit(0)), F.col("word"))).alias("word"))
        .where(F.col("size") > 0)
        .drop("size")
    )
    single = rarest.where(F.size("words") == 1)
    newest = top_rows(found, ["repo", "word"], newest_first(), hits).drop("rank")
    by_word = single.join(newest, ["repo", "word"]).select("repo", "query_id", "sha", "committed_at")
    several = rarest.where(F.size("words") > 1)
    meeting = spread_join(postings, several, ["repo", "word"]).where(F.size(F.array_except("words", "has")) == 0)
    by_words = top_rows(meeting.select("repo", "query_id", "sha", "committed_at"), ["repo", "query_id"], newest_first(), hits).drop("rank")
    return by_word.unionByName(by_words)


def candidates_by_terms(signatures: DataFrame, commits: DataFrame, hits: int = 5, groups: Sequence[int] = (4, 2, 1)) -> DataFrame:
    """Commits whose message has the first 4 terms, else the first 2, else the first one.

    The newest hits of a query within the look-back are the newest hits of all
    that are young enough, so queries do not depend on the day and equal term
    groups of different days are asked once.
    """
    words = F.transform(F.slice("terms", 1, 6), lambda t: F.lower(t))
    tiers = F.array_distinct(F.array(*[F.array_sort(F.array_distinct(F.slice(words, 1, n))) for n in groups]))
    asked = signatures.where(F.size("terms") > 0).select("sig_id", "repo", "since", F.posexplode(tiers).alias("tier", "words"))
    asked = asked.withColumn("query_id", F.md5(F.array_join("words", "\n").cast("binary")))
    queries = asked.groupBy("repo", "query_id").agg(F.first("words").alias("words"))
    answers = commit_search(queries, commits, hits).groupBy("repo", "query_id").agg(F.collect_list(F.struct("sha", "committed_at")).alias("found"))
    met = spread_join(asked.drop("words"), answers, ["repo", "query_id"])
    young = met.withColumn("found", F.filter("found", lambda c: F.to_date(c["committed_at"]) >= F.col("since"))).where(F.size("found") > 0)
    best = young.groupBy("sig_id").agg(F.min_by("found", "tier").alias("found"))
    return best.select("sig_id", F.explode("found.sha").alias("sha"))


def candidates_recent(signatures: DataFrame, commits: DataFrame, limit: int = 10) -> DataFrame:
    """The latest commits of the branch within the look-back."""
    newest = top_rows(of_any_branch(commits.select("repo", "branch", "sha", "committed_at"), signatures), ["repo", "branch"], newest_first(), limit)
    met = spread_join(signatures.select("sig_id", "repo", "branch", "since"), newest, ["repo", "branch"])
    return met.where(F.to_date("committed_at") >= F.col("since")).select("sig_id", "sha")


def path_points(filename: Column, path: Column) -> Column:
    """Points of a changed file for a source path: same or longer path, same name, or null."""
    ends = filename.endswith(F.concat(F.lit("/"), path)) | path.endswith(F.concat(F.lit("/"), filename))
    name = lambda p: F.substring_index(p, "/", -1)
    return F.when((filename != "") & (path != ""), F.when((filename == path) | ends, domain.PATH_POINTS).when(name(filename) == name(path), domain.BASENAME_POINTS))


def evidence_items(pairs: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Items of evidence (kind, value, at, points, shown) of each changed file for each (signature, commit) pair.

    Whether a term or path is in a file does not depend on the signature: each
    distinct term and path asked of a commit is tested once against its files.
    The signatures then meet the hits, and never the patch text.

    With ``members`` (``repo, commits, sha``) a pair names a set of commits (``commits``) and not one
    (``sha``): what a signature asks of the ten commits of its branch is then one row, and only hits are rows per commit.
    """
    if members is None:
        pairs = pairs.withColumn("commits", F.col("sha"))
    lower_terms = F.transform("terms", lambda t: F.lower(t))
    asked = pairs.select("sig_id", "repo", "commits", F.posexplode(F.arrays_zip(F.col("terms"), lower_terms.alias("low"))).alias("at", "t"))
    asked = asked.select("sig_id", "repo", "commits", "at", F.col("t.terms").alias("value"), F.col("t.low").alias("low"))
    on_path = pairs.select("sig_id", "repo", "commits", F.posexplode("paths").alias("at", "path"))

    def of_commits(asks: DataFrame) -> DataFrame:
        return asks.withColumn("sha", F.col("commits")) if members is None else asks.join(members, ["repo", "commits"])

    patch = F.coalesce("patch", F.lit(""))
    clean = F.btrim(F.replace("filename", F.lit("\\"), F.lit("/")), F.lit("/"))
    changed = _that_may_meet(files, pairs if members is None else members, ["repo", "sha"]).select(
        "repo", "sha", "position", "filename", clean.alias("clean"), patch.alias("patch"), F.lower(patch).alias("patch_low")
    )
    lines = F.split("patch", r"\r\n|[\n\r]")

    def snippet(line: Column) -> Column:
        return texts.truncate_text(F.concat("filename", F.lit(": "), texts.strip(line)), 240)

    in_patch = F.contains("patch_low", "low")
    line = snippet(F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.col("low"))), 0))
    # A file meets the different terms of its commit as arrays, so its patch is copied once per ``TERMS_AT_ONCE`` terms and not per term.
    terms = asked.groupBy("repo", "commits").agg(F.collect_set("low").alias("terms"))
    starts = F.sequence(F.lit(1), F.size("terms"), F.lit(TERMS_AT_ONCE))
    parts = terms.select("repo", "commits", F.explode(F.transform(starts, lambda at: F.slice("terms", at, TERMS_AT_ONCE))).alias("terms"))
    found = F.filter("terms", lambda t: F.contains(F.col("patch_low"), t) | F.contains(F.lower("filename"), t))
    tested = changed.join(of_commits(parts), ["repo", "sha"]).withColumn("low", F.explode(found)).drop("terms")
    term_hits = checkpointed(tested.select(
        "repo", "commits", "sha", "low", "position", "filename", F.when(in_patch, "term_diff").otherwise("term_file").alias("kind"),
        F.when(in_patch, domain.PATCH_TERM_POINTS).otherwise(domain.FILENAME_TERM_POINTS).cast("bigint").alias("points"), F.when(in_patch, line).alias("shown"),
    ))
    edited = F.get(F.filter(lines, lambda x: x.rlike(r"^[+-]") & ~x.startswith("+++") & ~x.startswith("---")), 0)
    points = path_points(F.col("clean"), F.col("path"))
    path_hits = checkpointed(changed.join(of_commits(on_path.select("repo", "commits", "path").distinct()), ["repo", "sha"]).where(points.isNotNull()).select(
        "repo", "commits", "sha", "path", "position", "filename", points.cast("bigint").alias("points"),
        snippet(F.coalesce(edited, F.concat(F.lit("changed file matched "), F.col("path")))).alias("line"),
    ))
    columns = ("sig_id", "sha", "position", "filename", "kind", "value", "at", "points", "shown")
    by_low, by_path = ["repo", "commits", "low"], ["repo", "commits", "path"]
    by_term = spread_join(_that_may_meet(asked, term_hits, by_low), term_hits, by_low).withColumn("at", F.col("at") + 100).select(*columns)
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    item = lambda kind, value, at, gained: F.struct(F.lit(kind).alias("kind"), value.alias("value"), at.alias("at"), gained.alias("points"))
    three = F.array(
        item("path", F.col("path"), F.col("at"), F.col("points")), item("snippet", F.col("line"), F.col("at"), zero), item("file", F.col("filename"), F.lit(0), zero)
    )
    met = spread_join(_that_may_meet(on_path, path_hits, by_path), path_hits, by_path).select("sig_id", "sha", "position", "filename", F.explode(three).alias("x"))
    return by_term.unionByName(met.select("sig_id", "sha", "position", "filename", "x.*", none.alias("shown")))


def diff_evidence(pairs: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Evidence of each (signature, commit) pair: capped lists in order and a score of at most 160.

    Lists are cut to their caps by rank before they are gathered, so a commit
    of any size gives a bounded row. ``members`` is as for ``evidence_items``.
    """
    place = F.struct("position", "filename", "at")
    first = evidence_items(pairs, files, members).groupBy("sig_id", "sha", "kind", "value").agg(
        F.min(place).alias("place"), F.min_by("shown", place).alias("shown"), F.sum("points").alias("points")
    )
    # The line of a term is shown once, from the first file that has it; then equal lines are merged.
    both = first.select(
        "sig_id", "sha",
        F.explode(
            F.filter(
                F.array(
                    F.struct("kind", "value", "place", "points"),
                    F.struct(F.lit("snippet").alias("kind"), F.col("shown").alias("value"), F.col("place"), F.lit(0).cast("bigint").alias("points")),
                    F.struct(F.lit("score").alias("kind"), F.lit("").alias("value"), F.col("place"), F.col("points")),
                ),
                lambda x: x["value"].isNotNull(),
            )
        ).alias("x"),
    )
    # The items of a pair are brought together once, for all three steps below.
    both = both.repartition("sig_id", "sha")
    merged = both.groupBy("sig_id", "sha", "x.kind", "x.value").agg(F.min("x.place").alias("place"), F.sum("x.points").alias("points"))
    longest = max(cap for _, _, cap in LISTS)
    ranked = top_rows(merged, ["sig_id", "sha", "kind"], ["place", "value"], longest)

    def values(kind: str, cap: int) -> Column:
        picked = F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= cap), F.struct("rank", "value")))
        return F.transform(F.array_sort(picked), lambda x: x["value"])

    score = F.max(F.when(F.col("kind") == "score", F.col("points")))
    return ranked.groupBy("sig_id", "sha").agg(
        *[values(kind, cap).alias(name) for kind, name, cap in LISTS],
        F.least(F.coalesce(score, F.lit(0)), F.lit(domain.EVIDENCE_SCORE_CAP)).cast("bigint").alias("diff_score"),
    )


def related_commit() -> Column:
    """A commit whose diff has a matched path, a matched term, or enough points."""
    return (F.size("matched_source_paths") > 0) | (F.size("matched_terms_in_diff") > 0) | (F.col("diff_score") >= domain.RELATED_SCORE)


def consecutive_reviews(signatures: DataFrame, commits: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """Related commits among the latest of the branch, each judged by its own diff."""
    recent = checkpointed(consecutive_commits(signatures, commits, limit))
    evidence = _history_evidence(signatures, recent, files).where(related_commit())
    named = evidence.join(signatures.select("sig_id", "repo", "branch"), "sig_id")
    return spread_join(named, recent, ["repo", "branch", "sha"]).drop("repo", "branch")


def _history_evidence(signatures: DataFrame, recent: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence of each signature in the latest commits of its branch."""
    asks = signatures.select("sig_id", "repo", F.col("branch").alias("commits"), "paths", "terms")
    return diff_evidence(asks, files, recent.select("repo", F.col("branch").alias("commits"), "sha"))


def _signals(found: DataFrame, source: str, precedence: int, name: Column | None = None, order: Column | None = None) -> DataFrame:
    return found.select(
        "sig_id", "sha",
        F.struct(
            F.lit(precedence).alias("precedence"), (F.lit(0) if order is None else order).cast("int").alias("order"),
            (F.lit(source) if name is None else name).alias("source"), F.lit(domain.SOURCE_POINTS[source]).cast("bigint").alias("points"),
        ).alias("signal"),
    )


def merge_candidates(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per (signature, commit): scores of all sources add up, the first source names it."""
    gathered = signals.groupBy("sig_id", "sha").agg(F.collect_set("signal").alias("unsorted"))
    gathered = gathered.select("sig_id", "sha", F.array_sort("unsorted").alias("signals"))
    points = F.aggregate("signals", F.lit(0).cast("bigint"), lambda acc, s: acc + s["points"])
    n = F.size("signals")
    diff = F.coalesce("diff_score", F.lit(0))
    score = points + n * diff
    exact = F.exists("signals", lambda s: s["source"].isin("payload_commit_sha", "payload_sha_range"))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(name, empty).alias(name) for _, name, _ in LISTS]
    joined = gathered.join(evidence, ["sig_id", "sha"], "left")
    return joined.select(
        "sig_id", "sha", score.cast("bigint").alias("score"), (n * diff).cast("bigint").alias("diff_score"),
        F.least(n * diff, F.lit(domain.EVIDENCE_SCORE_CAP)).cast("bigint").alias("evidence_score"),
        F.when(score >= 80, "high").when(score >= domain.RELATED_SCORE, "medium").otherwise("low").alias("confidence"),
        ((F.size(F.coalesce("matched_source_paths", empty)) > 0) | (F.size(F.coalesce("matched_terms_in_diff", empty)) > 0)).alias("diff_match"),
        exact.alias("deployment_sha_match"), F.get("signals", F.lit(0))["source"].alias("source"),
        F.transform("signals", lambda s: s["source"]).alias("sources"), *lists,
    )


def impact_candidates(signatures: DataFrame, commits: DataFrame, files: DataFrame, history_limit: int = 10) -> DataFrame:
    """All commit candidates of each signature, merged over the look-ups.

    Message search runs only for signatures without a candidate so far, recent
    history only for those still without one.
    """
    signatures = checkpointed(signatures)
    shas = signatures.select("sig_id", "repo", "branch", "paths", "terms")
    recent = checkpointed(consecutive_commits(signatures, commits, history_limit))
    by_sha = candidates_by_sha(signatures, commits)
    by_range = candidates_by_range(signatures, commits)
    by_path = candidates_by_path(signatures, commits, files)
    direct = checkpointed(
        _signals(by_sha, "payload_commit_sha", 1)
        .unionByName(_signals(by_range, "payload_sha_range", 2))
        .unionByName(_signals(by_path, "path", 3, F.concat(F.lit("path:"), "path"), F.col("path_at")))
    )
    beside = direct.select("sig_id", "sha").distinct().join(shas, "sig_id").join(recent, ["repo", "branch", "sha"], "left_anti")
    in_history = checkpointed(_history_evidence(signatures, recent, files))
    evidence = in_history.unionByName(checkpointed(diff_evidence(beside.select("sig_id", "repo", "sha", "paths", "terms"), files)))
    reviewed = in_history.where(related_commit())
    signals = checkpointed(direct.unionByName(_signals(reviewed, "consecutive_history_diff", 0)))

    open_after_direct = signatures.join(signals.select("sig_id").distinct(), "sig_id", "left_anti")
    searched = checkpointed(candidates_by_terms(open_after_direct, commits))
    open_after_search = open_after_direct.join(searched.select("sig_id").distinct(), "sig_id", "left_anti")
    late = checkpointed(
        _signals(searched, "commit_message_search", 4).unionByName(
            _signals(candidates_recent(open_after_search, commits), "recent_branch_history", 5)
        )
    )
    late_pairs = late.select("sig_id", "sha").distinct().join(shas.drop("branch"), "sig_id")
    late_evidence = checkpointed(diff_evidence(late_pairs, files))
    every_signal = checkpointed(signals.unionByName(late))
    return merge_candidates(every_signal, evidence.unionByName(late_evidence))


def top_candidates(candidates: DataFrame, commits: DataFrame, limit: int = 5) -> DataFrame:
    """The best candidates of each signature by score, then date, then sha."""
    facts = _that_may_meet(commits, candidates, ["sha"]).groupBy(F.col("sha")).agg(
        F.max("committed_at").alias("committed_at"), F.first("message").alias("message"),
        *[F.first(c).alias(c) for c in ("author_name", "author_email", "author_login") if c in commits.columns],
    )
    # A recent commit is a candidate of very many signatures.
    dated = spread_join(candidates, facts, ["sha"])
    best = top_rows(dated, ["sig_id"], [F.col("score").desc(), F.col("committed_at").desc(), F.col("sha").desc()], limit)
    return best.withColumn("message", F.substring(F.substring_index("message", "\n", 1), 1, 240))


def impact_verdict(signatures: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdict and look-up status of each signature over all its candidates."""
    flags = candidates.groupBy("sig_id").agg(
        F.bool_or(F.col("diff_match") | F.col("deployment_sha_match")).alias("direct"),
        F.bool_or(F.col("source") == "commit_message_search").alias("by_message"),
        F.bool_and(F.col("source") == "recent_branch_history").alias("recent_only"),
        F.count(F.lit(1)).alias("candidates"),
    )
    failed = F.col("lookup_failed") if "lookup_failed" in signatures.columns else F.lit(False)
    joined = signatures.select("sig_id", failed.alias("lookup_failed")).join(flags, "sig_id", "left")
    none = F.col("candidates").isNull()
    # Verdicts and states.
    verdict = (
        F.when(F.col("direct"), "possible_developer_impact")
        .when(F.col("by_message"), "message_only_developer_candidate")
        .when(~none, "no_direct_developer_evidence")
        .when(F.col("lookup_failed"), "lookup_incomplete")
        .otherwise("no_developer_candidate_found")
    )
    status = (
        F.when(F.col("recent_only"), "recent_history_only")
        .when(~none, "candidates_found")
        .when(F.col("lookup_failed"), "lookup_failed")
        .otherwise("no_candidates_found")
    )
    return joined.select("sig_id", verdict.alias("verdict"), status.alias("status"), F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"))
