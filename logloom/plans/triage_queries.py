"""Commit evidence, incidents and the whole triage."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from logloom import domain
from logloom.operators import evidence, incidents, triage
from logloom.operators.indexing import with_order_index
from logloom.plans import duck
from logloom.plans.registry import query
from logloom.plans.tables import derived, spread, with_tables
from logloom.session import checkpointed

REPO = "acme/shop"


def signed_errors(spark, sf):
    return evidence.event_signatures(spread(spark, sf, "errors", "event_id", "received_at", "payload"), REPO)


class Tables:
    """The tables of one run; signatures are found once. Files are brought together only for queries that look at them."""

    def __init__(self, spark, sf):
        self.signed = checkpointed(signed_errors(spark, sf))
        self.signatures = evidence.distinct_signatures(self.signed)
        self.commits = checkpointed(derived(spark, sf, "commits"))
        self.of_files = spark, sf

    @cached_property
    def files(self):
        return checkpointed(derived(*self.of_files, "files"))

    def per_event(self, found):
        return self.signed.select("event_id", "sig_id").join(found, "sig_id").drop("sig_id")


SIG = f"""
sig0 AS (SELECT event_id, received_at, payload, message, {duck.branch(duck.near_value('payload', domain.BRANCH_KEYS))} AS branch, {duck.commit_sha(duck.near_value('payload', domain.COMMIT_SHA_KEYS))} AS commit_sha,
  {duck.commit_sha(duck.near_value('payload', domain.PREVIOUS_SHA_KEYS))} AS previous_sha, CAST(received_at AS DATE) - 14 AS since, {duck.paths('message', 'payload')} AS paths FROM errors),
sig AS (SELECT *, {duck.terms('message', 'payload', 'paths')} AS terms FROM sig0)"""

PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY committed_at, sha) - 1 AS position FROM commits)"
RECENT = """newest AS (SELECT branch, sha, committed_at, parent_sha, row_number() OVER (PARTITION BY branch ORDER BY committed_at DESC, sha DESC) AS history_rank FROM commits),
recent AS (SELECT branch, sha, committed_at, history_rank, coalesce(nullif(parent_sha, ''), lead(sha) OVER (PARTITION BY branch ORDER BY history_rank)) AS base_sha FROM newest WHERE history_rank <= 11 QUALIFY history_rank <= 10)"""

BY_SHA = "by_sha AS (SELECT s.event_id, c.sha FROM sig s JOIN commits c ON s.commit_sha = c.sha)"
BY_RANGE = f"""{PLACED},
by_range AS (SELECT s.event_id, c.sha FROM sig s JOIN placed h ON s.commit_sha = h.sha JOIN placed t ON s.previous_sha = t.sha AND t.branch = h.branch JOIN placed c ON c.branch = h.branch AND c.position > t.position AND c.position <= h.position AND c.position > h.position - 5)"""
BY_PATH = """touched AS (SELECT DISTINCT c.branch, f.filename AS path, c.sha, c.committed_at FROM files f JOIN commits c USING (sha)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch, path ORDER BY committed_at DESC, sha DESC) AS r FROM touched) WHERE r <= 3),
asked AS (SELECT event_id, branch, unnest(paths[1:5]) AS path, unnest(range(len(paths[1:5]))) AS path_at FROM sig),
by_path AS (SELECT a.event_id, l.sha, CAST(a.path_at AS INT) AS path_at, a.path FROM asked a JOIN latest l USING (branch, path))"""


def searched(sigs: str) -> str:
    return f"""tiers AS (SELECT event_id, since, tier, list_sort(list_distinct(list_transform(terms[1:n], lambda t: lower(t)))) AS words FROM {sigs}, (VALUES (0, 4), (1, 2), (2, 1)) AS v(tier, n) WHERE len(terms) > 0),
documents_of AS (SELECT sha, committed_at, list_distinct(list_transform(regexp_extract_all(lower(message), '[a-z0-9_.-]+'), lambda w: trim(w, '._-'))) AS has FROM commits),
matches AS (SELECT q.words, d.sha, d.committed_at FROM (SELECT DISTINCT words FROM tiers) q JOIN documents_of d ON list_has_all(d.has, q.words)),
tried AS (SELECT t.event_id, t.tier, m.sha, row_number() OVER (PARTITION BY t.event_id, t.tier ORDER BY m.committed_at DESC, m.sha DESC) AS r FROM tiers t JOIN matches m USING (words) WHERE CAST(m.committed_at AS DATE) >= t.since),
by_terms AS (SELECT event_id, sha FROM tried JOIN (SELECT event_id, min(tier) AS tier FROM tried GROUP BY 1) USING (event_id, tier) WHERE r <= 5)"""


def recents(sigs: str) -> str:
    return f"by_recent AS (SELECT s.event_id, n.sha FROM {sigs} s JOIN newest n USING (branch) WHERE n.history_rank <= 10 AND CAST(n.committed_at AS DATE) >= s.since)"


def evidence_sql(pairs: str, out: str) -> str:
    """Evidence of the pairs (event_id, sha) of one sub-query, as table ``out``."""
    points = "CASE WHEN filename = p OR ends_with(filename, '/' || p) OR ends_with(p, '/' || filename) THEN 70 WHEN regexp_extract(filename, '[^/]*$') = regexp_extract(p, '[^/]*$') THEN 25 ELSE 0 END"
    edited = "list_filter(string_split(patch, chr(10)), lambda x: (starts_with(x, '+') OR starts_with(x, '-')) AND NOT starts_with(x, '+++') AND NOT starts_with(x, '---'))[1]"
    named = "list_filter(string_split(patch, chr(10)), lambda x: contains(lower(x), lower(v)))[1]"
    return f"""
{out}_f AS (SELECT p.event_id, p.sha, f.position, f.filename, f.patch, s.paths, s.terms FROM (SELECT DISTINCT event_id, sha FROM {pairs}) p JOIN sig s USING (event_id) JOIN files f USING (sha)),
{out}_p AS (SELECT event_id, sha, position, filename, patch, unnest(paths) AS p, unnest(range(len(paths))) AS i FROM {out}_f),
{out}_t AS (SELECT event_id, sha, position, filename, patch, unnest(terms) AS v, unnest(range(len(terms))) + 100 AS i FROM {out}_f),
{out}_i0 AS (SELECT event_id, sha, position, filename, i, 'path' AS kind, p AS v, {points} AS points, filename || ': ' || trim(coalesce({edited}, 'changed file matched ' || p)) AS shown FROM {out}_p
  UNION ALL SELECT event_id, sha, position, filename, i, CASE WHEN contains(lower(patch), lower(v)) THEN 'term_diff' ELSE 'term_file' END, v,
   CASE WHEN contains(lower(patch), lower(v)) THEN 15 WHEN contains(lower(filename), lower(v)) THEN 8 ELSE 0 END, CASE WHEN contains(lower(patch), lower(v)) THEN filename || ': ' || trim({named}) END FROM {out}_t),
{out}_i AS (SELECT * FROM {out}_i0 WHERE points > 0),
{out}_all AS (SELECT event_id, sha, kind, v, (position, filename, i) AS place, row_number() OVER (PARTITION BY event_id, sha, kind, v ORDER BY position, filename, i) AS nth, shown FROM {out}_i
  UNION ALL SELECT event_id, sha, 'file', filename, (position, filename, 0), 1, NULL FROM {out}_i WHERE kind = 'path'),
{out}_snip AS (SELECT event_id, sha, 'snippet' AS kind, shown AS v, place FROM {out}_all WHERE kind = 'path' OR (kind = 'term_diff' AND nth = 1)),
{out}_vals AS (SELECT event_id, sha, kind, v, min(place) AS place FROM (SELECT event_id, sha, kind, v, place FROM {out}_all UNION ALL SELECT * FROM {out}_snip) GROUP BY ALL),
{out}_rank AS (SELECT *, row_number() OVER (PARTITION BY event_id, sha, kind ORDER BY place, v) AS r FROM {out}_vals),
{out}_s AS (SELECT event_id, sha, least(sum(points), 160) AS diff_score FROM {out}_i GROUP BY ALL),
{out} AS (SELECT event_id, sha, CAST(s.diff_score AS BIGINT) AS diff_score,
  coalesce(string_agg(v, '|' ORDER BY r) FILTER (WHERE kind = 'path' AND r <= 8), '') AS matched_source_paths, coalesce(string_agg(v, '|' ORDER BY r) FILTER (WHERE kind = 'file' AND r <= 8), '') AS matched_files,
  coalesce(string_agg(v, '|' ORDER BY r) FILTER (WHERE kind = 'term_diff' AND r <= 12), '') AS matched_terms_in_diff, coalesce(string_agg(v, '|' ORDER BY r) FILTER (WHERE kind = 'term_file' AND r <= 12), '') AS matched_terms_in_changed_files,
  coalesce(string_agg(v, '|' ORDER BY r) FILTER (WHERE kind = 'snippet' AND r <= 5), '') AS diff_snippets FROM {out}_rank JOIN {out}_s s USING (event_id, sha) GROUP BY ALL)"""


LIST_NAMES = [name for _, name, _ in evidence.LISTS]


def joined_lists(df):
    return df.withColumns({n: F.array_join(n, "|") for n in LIST_NAMES})


HISTORY_PAIRS = "history AS (SELECT s.event_id, r.sha, r.base_sha, r.history_rank FROM sig s JOIN recent r USING (branch) WHERE r.base_sha IS NOT NULL)"
RELATED = "(matched_source_paths <> '' OR matched_terms_in_diff <> '' OR diff_score >= 35)"


@query("event_signatures", with_tables(f"WITH {SIG} SELECT event_id, message, branch, commit_sha, previous_sha, CAST(since AS VARCHAR) AS since, array_to_string(paths, '|') AS paths, array_to_string(terms, '|') AS terms FROM sig", "errors"))
def _(spark, sf):
    signed = signed_errors(spark, sf)
    return signed.select("event_id", "message", "branch", "commit_sha", "previous_sha", F.col("since").cast("string").alias("since"), F.array_join("paths", "|").alias("paths"), F.array_join("terms", "|").alias("terms"))


@query("branch_history", with_tables(f"WITH {RECENT} SELECT branch, sha, base_sha, history_rank FROM recent", "commits"))
def _(spark, sf):
    return evidence.branch_history(derived(spark, sf, "commits")).select("branch", "sha", "base_sha", "history_rank")


@query("branch_position", with_tables(f"WITH {PLACED} SELECT branch, sha, position FROM placed", "commits"))
def _(spark, sf):
    commits = derived(spark, sf, "commits").select("repo", "branch", "sha", "committed_at")
    return with_order_index(commits, ["committed_at", "sha"], ["repo", "branch"], "position").select("branch", "sha", "position")


@query("candidates_by_sha", with_tables(f"WITH {SIG}, {BY_SHA} SELECT event_id, sha FROM by_sha", "errors", "commits"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.candidates_by_sha(t.signatures, t.commits))


@query("candidates_by_range", with_tables(f"WITH {SIG}, {BY_RANGE} SELECT event_id, sha FROM by_range", "errors", "commits"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.candidates_by_range(t.signatures, t.commits))


@query("candidates_by_path", with_tables(f"WITH {SIG}, {BY_PATH} SELECT event_id, sha, path_at, path FROM by_path", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.candidates_by_path(t.signatures, t.commits, t.files))


@query("candidates_by_terms", with_tables(f"WITH {SIG}, {searched('sig')} SELECT event_id, sha FROM by_terms", "errors", "commits"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.candidates_by_terms(t.signatures, t.commits))


@query("candidates_recent", with_tables(f"WITH {SIG}, {RECENT}, {recents('sig')} SELECT event_id, sha FROM by_recent", "errors", "commits"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.candidates_recent(t.signatures, t.commits))


@query("diff_evidence", with_tables(f"WITH {SIG}, {RECENT}, {HISTORY_PAIRS}, {evidence_sql('history', 'ev')} SELECT * FROM ev", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(joined_lists(evidence.diff_evidence(evidence.consecutive_pairs(t.signatures, t.commits), t.files)))


@query("consecutive_reviews", with_tables(f"WITH {SIG}, {RECENT}, {HISTORY_PAIRS}, {evidence_sql('history', 'ev')} SELECT h.event_id, h.sha, h.base_sha, h.history_rank, ev.diff_score FROM ev JOIN history h USING (event_id, sha) WHERE {RELATED}", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    return t.per_event(evidence.consecutive_reviews(t.signatures, t.commits, t.files)).select("event_id", "sha", "base_sha", "history_rank", "diff_score")


IMPACT = f"""{SIG}, {RECENT}, {HISTORY_PAIRS}, {BY_SHA}, {BY_RANGE}, {BY_PATH},
direct AS (SELECT event_id, sha, 1 AS precedence, 0 AS ord, 'payload_commit_sha' AS source, 100 AS points FROM by_sha UNION ALL SELECT event_id, sha, 2, 0, 'payload_sha_range', 75 FROM by_range UNION ALL SELECT event_id, sha, 3, path_at, 'path:' || path, 45 FROM by_path),
early_pairs AS (SELECT event_id, sha FROM history UNION SELECT event_id, sha FROM direct), {evidence_sql('early_pairs', 'ev')},
early AS (SELECT * FROM direct UNION ALL SELECT event_id, sha, 0, 0, 'consecutive_history_diff', 25 FROM ev JOIN history USING (event_id, sha) WHERE {RELATED}),
open1 AS (SELECT * FROM sig WHERE event_id NOT IN (SELECT event_id FROM early)), {searched('open1')},
open2 AS (SELECT * FROM open1 WHERE event_id NOT IN (SELECT event_id FROM by_terms)), {recents('open2')},
late AS (SELECT event_id, sha, 4 AS precedence, 0 AS ord, 'commit_message_search' AS source, 35 AS points FROM by_terms UNION ALL SELECT event_id, sha, 5, 0, 'recent_branch_history', 10 FROM by_recent), {evidence_sql('late', 'lv')},
signals AS (SELECT * FROM early UNION ALL SELECT * FROM late),
found AS (SELECT * FROM ev UNION ALL SELECT * FROM lv),
merged AS (SELECT event_id, sha, count(*) AS n, sum(points) AS points, string_agg(source, ',' ORDER BY precedence, ord) AS sources, bool_or(precedence IN (1, 2)) AS deployment_sha_match FROM signals GROUP BY ALL),
candidates AS (SELECT m.event_id, m.sha, CAST(m.points + m.n * coalesce(f.diff_score, 0) AS BIGINT) AS score, CAST(m.n * coalesce(f.diff_score, 0) AS BIGINT) AS diff_score, m.sources, string_split(m.sources, ',')[1] AS source, m.deployment_sha_match,
  coalesce(f.matched_source_paths, '') <> '' OR coalesce(f.matched_terms_in_diff, '') <> '' AS diff_match, coalesce(f.diff_snippets, '') AS diff_snippets FROM merged m LEFT JOIN found f USING (event_id, sha))"""


@query("impact_candidates", with_tables(f"WITH {IMPACT} SELECT event_id, sha, score, diff_score, sources, source, deployment_sha_match, diff_match, diff_snippets FROM candidates", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    found = joined_lists(evidence.impact_candidates(t.signatures, t.commits, t.files)).withColumn("sources", F.array_join("sources", ","))
    return t.per_event(found).select("event_id", "sha", "score", "diff_score", "sources", "source", "deployment_sha_match", "diff_match", "diff_snippets")


@query("top_candidates", with_tables(f"""WITH {IMPACT}, ranked AS (SELECT d.event_id, d.sha, d.score, CAST(row_number() OVER (PARTITION BY d.event_id ORDER BY d.score DESC, c.committed_at DESC, d.sha DESC) AS INT) AS rank, c.author_name, left(c.message, 240) AS message FROM candidates d JOIN commits c USING (sha))
  SELECT * FROM ranked WHERE rank <= 5""", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    found = checkpointed(evidence.impact_candidates(t.signatures, t.commits, t.files))
    return t.per_event(evidence.top_candidates(found, t.commits)).select("event_id", "sha", "score", "rank", "author_name", "message")


VERDICT = """flags AS (SELECT event_id, bool_or(diff_match OR deployment_sha_match) AS direct, bool_or(source = 'commit_message_search') AS by_message, bool_and(source = 'recent_branch_history') AS recent_only, count(*) AS candidates FROM candidates GROUP BY 1),
verdicts AS (SELECT s.event_id, CASE WHEN f.direct THEN 'possible_developer_impact' WHEN f.by_message THEN 'message_only_developer_candidate' WHEN f.candidates > 0 THEN 'no_direct_developer_evidence' ELSE 'no_developer_candidate_found' END AS verdict,
  CASE WHEN f.recent_only THEN 'recent_history_only' WHEN f.candidates > 0 THEN 'candidates_found' ELSE 'no_candidates_found' END AS status, coalesce(f.candidates, 0) AS candidates FROM sig s LEFT JOIN flags f USING (event_id))"""


@query("impact_verdict", with_tables(f"WITH {IMPACT}, {VERDICT} SELECT * FROM verdicts", "errors", "commits", "files"))
def _(spark, sf):
    t = Tables(spark, sf)
    found = evidence.impact_candidates(t.signatures, t.commits, t.files)
    return t.per_event(evidence.impact_verdict(t.signatures, found))


INCIDENTS = f"""keyed AS (SELECT event_id, received_at, {duck.summary("'Incident: ' || message")} AS summary FROM errors),
keyed2 AS (SELECT *, {duck.fold(duck.collapse('summary'))} AS summary_key FROM keyed),
known AS (SELECT {duck.fold(duck.collapse('summary'))} AS summary_key, max_by(issue_key, (updated, issue_key)) AS known_key FROM issues GROUP BY 1),
opened AS (SELECT k.event_id, k.summary, coalesce(n.known_key, 'NEW-' || left(md5(k.summary_key), 12)) AS issue_key,
  CASE WHEN n.known_key IS NULL AND row_number() OVER (PARTITION BY k.summary_key ORDER BY k.received_at, k.event_id) = 1 THEN 'created' ELSE 'reused' END AS operation FROM keyed2 k LEFT JOIN known n USING (summary_key))"""
FOLLOW = """named AS (SELECT kind, number, state, html_url, title, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]+-[A-Za-z0-9]+)\\b', 1))) AS issue_key FROM refs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY CASE WHEN kind = 'pull_request' THEN 0 ELSE 1 END, number) AS r FROM named) WHERE r = 1)"""


@query("dedupe_incidents", with_tables(f"WITH {INCIDENTS} SELECT event_id, summary, issue_key, operation FROM opened", "errors", "issues"))
def _(spark, sf):
    return incidents.dedupe_incidents(derived(spark, sf, "errors"), derived(spark, sf, "issues"))


@query("dedupe_remediation", with_tables(f"""WITH {FOLLOW} SELECT DISTINCT i.issue_key, CASE WHEN b.kind IS NULL THEN 'created' ELSE 'reused' END AS operation, coalesce(b.kind, 'task') AS kind, b.number, b.state, b.html_url, b.title
  FROM issues i LEFT JOIN best b USING (issue_key)""", "issues", "refs"))
def _(spark, sf):
    return incidents.dedupe_remediation(derived(spark, sf, "issues"), derived(spark, sf, "refs"))


@query("route_actions", with_tables("""SELECT event_id, prediction, unnest(CASE prediction WHEN 'Error' THEN [0, 1] ELSE [0] END) AS step, unnest(CASE prediction WHEN 'Noise' THEN ['ignore'] WHEN 'Error' THEN ['jira', 'github_copilot_remediation'] WHEN 'Other' THEN ['none'] ELSE ['email'] END) AS type,
  CASE prediction WHEN 'CONFIGURATION' THEN 'configuration' WHEN 'SYSTEM' THEN 'system' END AS target, CASE prediction WHEN 'Error' THEN 'create' WHEN 'CONFIGURATION' THEN 'send' WHEN 'SYSTEM' THEN 'send' END AS operation FROM results""", "results"))
def _(spark, sf):
    return incidents.route_actions(derived(spark, sf, "results"))


@query("triage", with_tables(f"""WITH {IMPACT}, {VERDICT}, {INCIDENTS}, {FOLLOW}
  SELECT v.event_id, 'Error' AS prediction, v.verdict, v.status, o.issue_key, o.operation, CASE WHEN b.kind = 'pull_request' THEN 'github_pull_request' ELSE 'github_copilot_remediation' END AS follow_type, CASE WHEN b.kind IS NULL THEN 'created' ELSE 'reused' END AS follow_operation
  FROM verdicts v JOIN opened o USING (event_id) LEFT JOIN best b USING (issue_key)""", "errors", "commits", "files", "issues", "refs"))
def _(spark, sf):
    events = spread(spark, sf, "errors", "event_id", "received_at", "payload").select("*", F.lit('{"class": "error"}').alias("answer"))
    out = triage.triage(events, *[checkpointed(derived(spark, sf, n)) for n in ("commits", "files", "issues", "refs")], REPO)["results"]
    follow = F.get("actions", F.lit(1))
    return out.select("event_id", "prediction", "verdict", "status", "issue_key", "operation", follow["type"].alias("follow_type"), follow["operation"].alias("follow_operation"))
