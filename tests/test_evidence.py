from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import evidence, incidents, triage
from logloom.operators.skew import spread_join, top_rows

REPO = "acme/shop"
SHA = [f"{i:x}" * 40 for i in range(1, 12)]


@pytest.fixture(scope="module")
def commits(spark):
    """Eleven commits in a row on main; the fifth newest touches the file of the error."""
    rows = [(REPO, "main", SHA[i], SHA[i + 1] if i < 10 else "", f"Change {i} of docs", "Ann", datetime(2024, 1, 20) - timedelta(days=i)) for i in range(11)]
    return spark.createDataFrame(rows, "repo string, branch string, sha string, parent_sha string, message string, author_name string, committed_at timestamp")


@pytest.fixture(scope="module")
def files(spark):
    rows = [(REPO, SHA[i], 0, "docs/readme.md", "@@\n+words only") for i in range(11) if i != 4]
    rows += [(REPO, SHA[4], 0, "src/app/pay.py", "--- a\n+++ b\n-old line\n+ raise PaymentError here"), (REPO, SHA[4], 1, "tests/pay.py", "+x")]
    return spark.createDataFrame(rows, "repo string, sha string, position int, filename string, patch string")


def events(spark, *payloads):
    rows = [(i, datetime(2024, 1, 21), p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "event_id bigint, received_at timestamp, payload string")


def impact(spark, commits, files, *payloads):
    signed = evidence.event_signatures(events(spark, *payloads), REPO, "main")
    signatures = evidence.distinct_signatures(signed)
    candidates = evidence.impact_candidates(signatures, commits, files)
    return signed, signatures, candidates


def test_commits_without_a_branch_meet_events_that_name_none(spark):
    rows = [(REPO, "main", "a"), (REPO, None, "b"), (REPO, "", "c"), (REPO, "dev", "a")]
    found = evidence.of_any_branch(spark.createDataFrame(rows, "repo string, branch string, sha string")).collect()
    assert sorted((r.branch, r.sha) for r in found) == [("", "a"), ("", "b"), ("", "c"), ("dev", "a"), ("main", "a")]


def test_the_fifth_of_ten_diffs_wins(spark, commits, files):
    signed, signatures, found = impact(spark, commits, files, '{"message":"PaymentError in src/app/pay.py line 3"}')
    top = evidence.top_candidates(found, commits).orderBy("rank").first()
    assert top["sha"] == SHA[4] and top["source"] == "consecutive_history_diff" and top["confidence"] == "high"
    # One path exact 70, one same name 25, PaymentError in the patch 15, file name terms; plus the path look-up.
    assert top["sources"] == ["consecutive_history_diff", "path:src/app/pay.py"]
    assert top["matched_source_paths"] == ["src/app/pay.py"] and top["matched_files"] == ["src/app/pay.py", "tests/pay.py"]
    assert "PaymentError" in top["matched_terms_in_diff"]
    assert top["diff_snippets"][0] == "src/app/pay.py: -old line"
    assert evidence.impact_verdict(signatures, found).first()["verdict"] == "possible_developer_impact"


def test_payload_sha_and_range(spark, commits, files):
    _, _, found = impact(spark, commits, files, f'{{"message":"zzzz","git":{{"sha":"{SHA[1][:9]}","before":"{SHA[8]}"}}}}')
    sources = {r["sha"]: r["sources"] for r in found.collect()}
    assert sources[SHA[1]] == ["payload_commit_sha", "payload_sha_range"]
    assert {s for s, names in sources.items() if "payload_sha_range" in names} == {SHA[i] for i in range(1, 6)}
    scores = {r["sha"]: r["score"] for r in found.collect()}
    assert scores[SHA[1]] == 175 and scores[SHA[2]] == 75


def test_recent_history_when_nothing_matches(spark, commits, files):
    _, signatures, found = impact(spark, commits, files, '{"msg":"qqqq zzzz"}')
    assert found.select("source").distinct().collect()[0][0] == "recent_branch_history"
    verdict = evidence.impact_verdict(signatures, found).first()
    assert (verdict["verdict"], verdict["status"]) == ("no_direct_developer_evidence", "recent_history_only")


def test_message_search_uses_four_then_two_then_one_term(spark, commits):
    rows = [(REPO, "b", c * 40, "", m, "A", datetime(2024, 1, d)) for c, m, d in
            [("a", "alpha beta", 10), ("b", "alpha only", 11), ("c", "alpha beta gamma delta", 9), ("d", "omega", 1)]]
    table = spark.createDataFrame(rows, commits.schema)
    schema = "sig_id string, repo string, branch string, since date, terms array<string>"
    def asks(*terms):
        return spark.createDataFrame([("s", REPO, "b", datetime(2024, 1, 5).date(), list(terms))], schema)
    hits = lambda *terms: sorted(r["sha"][0] for r in evidence.candidates_by_terms(asks(*terms), table).collect())
    assert hits("Alpha", "beta", "gamma", "delta") == ["c"]
    assert hits("alpha", "beta", "nothing", "here") == ["a", "c"]
    assert hits("alpha", "zzz", "nothing", "here") == ["a", "b", "c"]
    assert hits("omega") == []  # too old
    assert hits("zzz") == []


def test_equal_events_share_one_signature(spark):
    same = ['{"message":"PaymentError in src/app/pay.py"}'] * 50 + ['{"message":"other words"}']
    signed = evidence.event_signatures(events(spark, *same), REPO, "main")
    assert evidence.distinct_signatures(signed).count() == 2


def test_lists_are_capped_and_scores_limited(spark):
    pairs = spark.createDataFrame([("s", REPO, "c1", [f"p{i}/x.py" for i in range(8)], ["word"])], "sig_id string, repo string, sha string, paths array<string>, terms array<string>")
    many = spark.createDataFrame([(REPO, "c1", i, f"d{i}/x.py", f"+word {i}") for i in range(40)], "repo string, sha string, position int, filename string, patch string")
    row = evidence.diff_evidence(pairs, many).first()
    assert row["diff_score"] == 160
    assert row["matched_files"] == [f"d{i}/x.py" for i in range(8)]
    assert row["diff_snippets"] == [f"d{i}/x.py: +word {i}" for i in range(5)]


def test_spread_join_equals_plain_join(spark, rows):
    many = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"))
    few = spark.createDataFrame([(k, c) for k in range(40) for c in "ab"], "k bigint, c string")
    for how in ("inner", "left"):
        split = spread_join(many, few, ["k"], how, hot_rows=100)
        assert rows(split, "id", "k", "c") == rows(many.join(few, ["k"], how), "id", "k", "c")


def test_top_rows_cuts_before_the_shuffle(spark):
    df = top_rows(spark.range(100).select("id", (F.col("id") % 3).alias("g")), ["g"], [F.col("id").desc()], 2)
    assert sorted(r["id"] for r in df.collect()) == [94, 95, 96, 97, 98, 99]
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 1


def test_incidents_are_reused_by_summary(spark):
    rows = [(1, datetime(2024, 1, 1), "Disk  full"), (2, datetime(2024, 1, 2), "disk full"), (3, datetime(2024, 1, 1), "known thing")]
    issues = spark.createDataFrame([("OPS-1", "INCIDENT: known\tthing", 5), ("OPS-2", "Incident: Known thing", 7)], "issue_key string, summary string, updated int")
    got = {r["event_id"]: (r["issue_key"], r["operation"]) for r in incidents.dedupe_incidents(spark.createDataFrame(rows, "event_id int, received_at timestamp, message string"), issues).collect()}
    assert got[3] == ("OPS-2", "reused")
    assert got[1][1] == "created" and got[2] == (got[1][0], "reused")


def test_remediation_prefers_pull_requests(spark):
    refs = spark.createDataFrame([("issue", 1, "open", "u1", "t", "for OPS-1"), ("pull_request", 9, "open", "u9", "t", "fix OPS-1, OPS-2"), ("issue", 3, "open", "u3", "t", "OPS-3")],
                                 "kind string, number int, state string, html_url string, title string, text string")
    keys = spark.createDataFrame([("OPS-1",), ("OPS-3",), ("OPS-4",)], "issue_key string")
    got = {r["issue_key"]: (r["operation"], r["kind"], r["number"]) for r in incidents.dedupe_remediation(keys, refs).collect()}
    assert got == {"OPS-1": ("reused", "pull_request", 9), "OPS-3": ("reused", "issue", 3), "OPS-4": ("created", "task", None)}


def test_triage_of_every_label(spark, commits, files):
    table = spark.createDataFrame(
        [(1, datetime(2024, 1, 21), '{"message":"PaymentError in src/app/pay.py"}', "error"), (2, datetime(2024, 1, 21), '{"message":"m"}', '{"label":"configuration"}'),
         (3, datetime(2024, 1, 21), "GET / 200", None), (4, datetime(2024, 1, 21), "m", "odd")],
        "event_id bigint, received_at timestamp, payload string, answer string")
    issues = spark.createDataFrame([], "issue_key string, summary string, updated int")
    refs = spark.createDataFrame([], "kind string, number int, state string, html_url string, title string, text string")
    out = triage.triage(table, commits, files, issues, refs, REPO, "main")
    got = {r["event_id"]: (r["prediction"], [a["type"] for a in r["actions"]]) for r in out["results"].collect()}
    assert got == {1: ("Error", ["jira", "github_copilot_remediation"]), 2: ("CONFIGURATION", ["email"]), 3: ("Noise", ["ignore"]), 4: ("odd", ["none"])}
    assert out["candidates"].orderBy("rank").first()["sha"] == SHA[4]


def test_asks_of_a_branch_equal_asks_of_its_commits(spark, rows):
    """Sets of commits as members give the evidence of single commits, and no row per commit goes into the join with the hits."""
    commits = [("r", "main", f"{i:040d}", "p", "m", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(4)] + [("r", "main", f"{2:040d}", "p", "m", datetime(2024, 1, 1) + timedelta(days=2))]
    commits = spark.createDataFrame(commits, "repo string, branch string, sha string, parent_sha string, message string, committed_at timestamp")
    files = spark.createDataFrame(
        [("r", f"{i:040d}", i % 2, f"app/f{i % 2}.py", "+raise Boom\n-quiet" if i != 1 else None) for i in range(6)] * 2, "repo string, sha string, position bigint, filename string, patch string"
    )
    signatures = spark.createDataFrame(
        [("s1", "r", "main", ["app/f0.py"], ["Boom", "quiet", "none"]), ("s2", "r", "main", [], ["boom", "f1.py"]), ("s3", "r", "", ["f1.py"], ["Boom"]), ("s4", "q", "main", [], ["Boom"])],
        "sig_id string, repo string, branch string, paths array<string>, terms array<string>",
    )
    single = evidence.diff_evidence(evidence.consecutive_pairs(signatures, commits), files)
    recent = evidence.consecutive_commits(signatures, commits)
    asks = signatures.select("sig_id", "repo", F.col("branch").alias("commits"), "paths", "terms")
    together = evidence.diff_evidence(asks, files, recent.select("repo", F.col("branch").alias("commits"), "sha"))
    assert rows(single) == rows(together) and single.count() > 6
    reviews = evidence.consecutive_reviews(signatures, commits, files)
    assert {r["sig_id"] for r in reviews.select("sig_id").collect()} == {"s1", "s2", "s3"}
    assert reviews.where(F.col("sig_id") == "s1").count() == single.where((F.col("sig_id") == "s1") & evidence.related_commit()).count() + 1  # one commit comes twice


def test_files_are_brought_together_only_where_they_are_asked_for(spark, monkeypatch):
    from logloom.plans import triage_queries

    made = []
    monkeypatch.setattr(triage_queries, "signed_errors", lambda spark, sf: spark.range(1).selectExpr("'s' AS sig_id", *[f"'' AS {c}" for c in evidence.SIGNATURE]))
    monkeypatch.setattr(triage_queries, "derived", lambda spark, sf, name: made.append(name) or spark.range(1))
    tables = triage_queries.Tables(spark, "")
    assert made == ["commits"]
    assert tables.files.count() == 1 and tables.files is tables.files and made == ["commits", "files"]
