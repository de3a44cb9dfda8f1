"""The registered queries of this package and the SQL that checks them.

A query gets its rows from its operator and derives the asked columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import align, ann, chat, imatch, langid, minhash, mixing, mtree, packing, repair, secret_scan, url_filter, warc
from logloom.llm.common import given

Query = Callable[[SparkSession, str], DataFrame]


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    given_rows = given(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.formatted(given_rows.unionByName(more), context=1)).drop("rewrites")


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, 4 + length(replace(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g'), ':', '\:')) + 2 + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) + 9 AS n FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(given(spark, folder, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), counted AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS h, s FROM sets),
classes AS (SELECT h, n, min(doc_id) AS c, any_value(s) AS s FROM counted WHERE n > 0 GROUP BY h, n),
items AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.g = b.g AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT c, c AS r FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(l.r, d.doc_id) AS component_id, d.doc_id = coalesce(l.r, d.doc_id) AS kept
FROM counted d LEFT JOIN classes k ON d.h = k.h AND d.n = k.n LEFT JOIN least l ON k.c = l.c
"""


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = given(spark, folder, "documents")
    found = langid.judged(docs.select("doc_id", "text"), langid.learned_from(docs))
    held = F.coalesce(langid.fold("doc.doc_id") == 2, F.lit(False))
    return found.select("doc.doc_id", held.alias("held_out"), "verdict.lang_pred", F.col("verdict.lang_score").alias("score"), "verdict.entropy")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(given(spark, folder, "pages"))


#: Steps of the propagation in SQL; at damping 0.85 what moves after them is below the rounding of a double.
SQL_STEPS = 240


def _url_sql() -> str:
    name = verdict = "CAST(NULL AS VARCHAR)"
    for kind, of, start in sorted(url_filter.RULES, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}')"
        name, verdict = f"CASE WHEN {fits} THEN '{of}{start}' ELSE {name} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    lowered = f"translate({{0}}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    host = lowered.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    href = url_filter.HREF.replace("'", "''")
    return f"""
WITH RECURSIVE parsed AS (SELECT page_id, html, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT page_id, html, host, path, {name} AS rule, {verdict} AS known FROM parsed),
links AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT host AS a, {lowered.format("unnest(regexp_extract_all(coalesce(html, ''), '" + href + "', 1))")} AS b FROM parsed) WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
hosts AS (SELECT host FROM parsed WHERE host <> '' UNION SELECT b FROM links),
up AS (SELECT l, unnest(range(1, len(l) - 1)) AS n FROM (SELECT string_split(host, '.') AS l FROM hosts) WHERE len(l) > 2),
steps AS (SELECT DISTINCT array_to_string(l[n:], '.') AS a, array_to_string(l[n + 1:], '.') AS b FROM up),
edges AS MATERIALIZED (SELECT a, b, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT a, b, 1.0 FROM steps UNION ALL SELECT b, a, 1.0 FROM steps) GROUP BY a, b),
seeds AS (SELECT known AS kind, host, CAST(count(*) AS DOUBLE) AS weight FROM ruled WHERE known IS NOT NULL AND host <> '' GROUP BY ALL),
ways AS (SELECT 'allow' AS kind, a, b, weight FROM edges UNION ALL SELECT 'block', b, a, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) AS share FROM ways),
moved AS (
  SELECT 0 AS n, kind, host, {1 - url_filter.DAMPING} * weight / sum(weight) OVER (PARTITION BY kind) AS mass FROM seeds
  UNION ALL SELECT n + 1, m.kind, b, sum({url_filter.DAMPING} * mass * share) FROM moved m JOIN shares s ON m.kind = s.kind AND m.host = s.a WHERE n < {SQL_STEPS} GROUP BY n, m.kind, b
), ranks AS (SELECT kind, host, sum(mass) / sum(sum(mass)) OVER (PARTITION BY kind) AS rank FROM moved GROUP BY kind, host),
blocked AS (SELECT host FROM ranks GROUP BY host HAVING coalesce(sum(rank) FILTER (kind = 'block'), 0) > {url_filter.THRESHOLD} * coalesce(sum(rank) FILTER (kind = 'allow'), 0) + 1e-12)
SELECT page_id, host, path, rule, coalesce(known, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = given(spark, folder, "documents").select("doc_id", secret_scan.find("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), number("random"), digest, secret_scan.written(F.col("found")).alias("spans"))


#: The mixture of op4 and of the pipeline: domains are ranges of source numbers, four fifths of all tokens are dealt.
DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web' WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'books' ELSE 'code' END"
MIX = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 3}}
SHARE, EPOCHS = (4, 5), 2


def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.copies(given(spark, folder, "documents"), F.expr(DOMAIN), mixing.word_count("text"), SHARE, EPOCHS, MIX)


def op3_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.compared(given(spark, folder, "documents"))


def _imatch_sql() -> str:
    """The terms of a text, the lexicon, the subsets' hashes and their likeness, as in the operator."""
    bounds = "[" + ", ".join(f"'{b}'" for b in imatch.SUBSETS) + "]"
    digests = r"list_transform(list_distinct(regexp_extract_all(lower({0}), '\p{{L}}+')), lambda t: md5(t))".replace("\\", "\\")
    bucket = f"substr({{0}}, 1, {imatch.DIGITS})"
    near = """CASE WHEN {0} = {1} THEN 1.0 ELSE CAST(len(list_filter(range(1, greatest(len({0}), len({1})) + 1), lambda i: {0}[i] = {1}[i] AND {0}[i] <> '')) AS DOUBLE)
      / greatest(1, len(list_filter(range(1, greatest(len({0}), len({1})) + 1), lambda i: coalesce({0}[i], '') <> '' OR coalesce({1}[i], '') <> ''))) END"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (
  SELECT doc_id, text, length(text) AS n, substr(text, 1, CAST(length(text) - length(text) // 2 AS BIGINT)) || substr(coalesce(lead(text) OVER o, first_value(text) OVER o), 1, CAST(length(text) // 2 AS BIGINT)) AS edited,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), texts AS (SELECT doc_id, 'own' AS kind, {digests.format('text')} AS t FROM e UNION ALL SELECT doc_id, 'other', {digests.format('edited')} FROM e),
lex AS (
  SELECT b FROM (SELECT doc_id, unnest(list_distinct(list_transform(t, lambda x: {bucket.format('x')}))) AS b FROM texts WHERE kind = 'own')
  GROUP BY b HAVING count(*) >= greatest({imatch.LEAST_DOCS}, (SELECT CAST(ceil(count(*) / {imatch.RARE}) AS BIGINT) FROM d)) AND count(*) <= (SELECT count(*) // {imatch.COMMON} FROM d)
), terms AS (SELECT doc_id, kind, unnest(t) AS x FROM texts),
known AS (SELECT doc_id, kind, list_sort(list(x)) AS k FROM terms JOIN lex ON {bucket.format('x')} = b GROUP BY ALL),
prints AS (
  SELECT t.doc_id, t.kind, CASE WHEN k IS NULL THEN ['*' || md5(array_to_string(list_sort(t.t), ''))] ELSE
    list_transform(range(1, {len(imatch.SUBSETS)} + 1), lambda i: CASE WHEN len(list_filter(k, lambda x: substr(x, i, 2) < {bounds}[i])) = 0 THEN ''
      ELSE substr(md5(array_to_string(list_filter(k, lambda x: substr(x, i, 2) < {bounds}[i]), '')), 1, 8) END) END AS p
  FROM texts t LEFT JOIN known USING (doc_id, kind)
)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.p, '-') AS fingerprint, array_to_string(b.p, '-') AS edited_fingerprint,
  {near.format('a.p', 'b.p')} AS near_edited, {near.format('a.p', 'c.p')} AS near_next
FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 'own' JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 'other' JOIN prints c ON c.doc_id = e.next_id AND c.kind = 'own'
"""


def _filled_sql(table: str, parent: str, name: str) -> str:
    """The SQL of one level: children of ``table`` (budget, held, weight) get ``given``."""
    return f"""
  SELECT *, least(held, CASE WHEN full_ THEN held ELSE greatest(lv.l, 0) * weight // lv.w END) AS given FROM (
    SELECT *, min(CASE WHEN NOT full_ THEN {{'r': held / weight, 'n': {name}, 'l': l, 'w': w}} END) OVER (PARTITION BY {parent}) AS lv FROM (
      SELECT *, held * w <= l * weight AS full_ FROM (
        SELECT *, CAST(budget - coalesce(sum(held) OVER (PARTITION BY {parent} ORDER BY held / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS l,
          CAST(sum(weight) OVER (PARTITION BY {parent} ORDER BY held / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w FROM {table})))"""


def _weight_sql(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX[kind].items()) + " ELSE 1 END"


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS tokens FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS held FROM d GROUP BY ALL),
total AS (SELECT CAST(sum(tokens) * {SHARE[0]} // {SHARE[1]} AS BIGINT) AS budget FROM leaves),
l1 AS (SELECT domain, CAST(sum(held) AS BIGINT) AS held, any_value(budget) AS budget, {_weight_sql('domain')} AS weight, 0 AS root FROM leaves, total GROUP BY domain),
g1 AS ({_filled_sql('l1', 'root', 'domain')}),
l2 AS (SELECT l.domain, l.lang, CAST(sum(l.held) AS BIGINT) AS held, any_value(g1.given) AS budget, {_weight_sql('lang')} AS weight FROM leaves l JOIN g1 ON l.domain = g1.domain GROUP BY l.domain, l.lang),
g2 AS ({_filled_sql('l2', 'domain', 'lang')}),
l3 AS (SELECT l.*, g2.given AS budget, {_weight_sql('source')} AS weight FROM leaves l JOIN g2 ON l.domain = g2.domain AND l.lang = g2.lang),
g3 AS ({_filled_sql('l3', 'domain, lang', 'source')}),
plans AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM g3),
placed AS (SELECT d.*, p.whole, p.rest, md5('1:' || p.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS k FROM d JOIN plans p USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM placed)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN rest > 0 AND 2 * upto - tokens <= 2 * rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run
"""


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived(given(spark, folder, "pages"))
    number = lambda name: F.col(name).cast("long").alias(name)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d
"""


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(given(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(given(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    return align.linked(given(spark, folder, "documents"), show=digest).withColumnRenamed("groups", "groups_sha256")


def op12_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(given(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired(given(spark, folder, "conversations"), repair.damaged).withColumnRenamed("key", "conv_id")


# The CRC goes by its table; costs go backwards and edits forwards, a step of a recursion each.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations
), lots AS (
  SELECT g.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS lot FROM given g, crc
), damaged AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM lots
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS body FROM damaged
), told AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed
), ids AS (SELECT DISTINCT conv_id FROM conversations),
-- Costs to go before row pos in the states start, system, user and assistant, and the letters of the choices.
back AS (
  SELECT i.conv_id, coalesce(max(n), 0) + 1 AS pos, [0, 10, 5, 0] AS c, ['', 'I', 'I', ''] AS l FROM ids i LEFT JOIN told t ON i.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY i.conv_id
  UNION ALL
  SELECT conv_id, pos, v, [CASE WHEN d[s] = v[s] THEN 'D' WHEN s IN (1, 2) AND 5 + v[3] = v[s] OR s = 3 AND 5 + v[4] = v[s] OR s = 4 AND 5 + v[3] = v[s] THEN 'I' WHEN k[s] = v[s] THEN 'K' ELSE 'R' END FOR s IN [1, 2, 3, 4]] FROM (
    SELECT conv_id, pos, d, k, [least(m[1], 5 + u), least(m[2], 5 + u), u, a] AS v FROM (
      SELECT *, least(m[3], 5 + m[4]) AS u, least(m[4], 5 + m[3]) AS a FROM (
        SELECT *, [least(d[s], r[s], k[s]) FOR s IN [1, 2, 3, 4]] AS m FROM (
          SELECT t.conv_id, t.pos, [2 + c[s] FOR s IN [1, 2, 3, 4]] AS d, [own + 1 + c[CASE s WHEN 3 THEN 4 ELSE 3 END] FOR s IN [1, 2, 3, 4]] AS r,
            [own + CASE WHEN s = 1 AND i = 's' THEN c[2] WHEN s <> 3 AND i = 'u' THEN c[3] WHEN s = 3 AND i = 'a' THEN c[4] ELSE 1000000000 END FOR s IN [1, 2, 3, 4]] AS k
          FROM back b JOIN (SELECT *, CASE fault WHEN 3 THEN 5 WHEN 0 THEN 0 ELSE 100000000 END AS own FROM told) t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = b.pos - 1))))
), forth AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS pos, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM ids
  UNION ALL
  SELECT f.conv_id, CASE WHEN b.l[f.s] = 'I' THEN f.pos ELSE f.pos + 1 END,
    CASE b.l[f.s] WHEN 'D' THEN f.s WHEN 'K' THEN CASE t.i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE f.s WHEN 3 THEN 4 ELSE 3 END END, audit || b.l[f.s],
    CASE b.l[f.s] WHEN 'D' THEN said WHEN 'K' THEN list_append(said, t.role || ':' || t.text) ELSE list_append(said, CASE f.s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE b.l[f.s] WHEN 'R' THEN t.text ELSE '' END) END
  FROM forth f JOIN back b ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos AND b.l[f.s] <> '' LEFT JOIN told t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.pos = t.pos
), last AS (SELECT f.* FROM forth f JOIN back b ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos AND b.l[f.s] = ''),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id
)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.c[1] AS BIGINT) AS cost, l.audit, sha256(array_to_string(l.said, chr(10))) AS repaired_sha256
FROM last l JOIN back b ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos = 1 LEFT JOIN facts f ON l.conv_id IS NOT DISTINCT FROM f.conv_id
"""


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_secrets": op2_secrets,
    "op3_imatch": op3_imatch,
    "op4_mixture": op4_mixture,
    "op5_chat": op5_chat,
    "op8_warc": op8_warc,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op11_alignment": op11_alignment,
    "op12_top_products": op12_top_products,
    "op13_repair": op13_repair,
}
ORACLE: dict[str, str] = {"op1_url_filter": _url_sql(), "op3_imatch": _imatch_sql(), "op4_mixture": OP4_SQL, "op5_chat": OP5_SQL, "op6_minhash": OP6_SQL, "op8_warc": OP8_SQL, "op12_top_products": OP12_SQL, "op13_repair": OP13_SQL}
