"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import base64
import gzip
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import ann, chat, imatch, langid, minhash, mixing, packing, queries, secret_scan, url_filter, warc

WORDS = " ".join(f"w{i} lorem{i % 7}" for i in range(60))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, key string, tokens string, band string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents in a table with more columns, named like those the operators use inside."""
    texts = [(1, WORDS), (2, WORDS + " end"), (3, "other words stand here alone"), (4, ""), (5, None), (6, WORDS), (6, WORDS), (None, "no id but text"), (8, "long " * 50_000), (9, "...")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else "src1", 0, "a", "b", "c", "d") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_minhash(docs, nothing):
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs).collect()}
    assert minhash.near_duplicates(docs).count() == docs.count()
    assert [got[k].component_id for k in got if k[0] in (1, 2, 6)] == [1, 1, 1]
    assert got[(4, 0)].component_id == 4 and got[(5, 0)].kept and got[(3, 1)].kept and got[(8, 1)].kept
    assert got[(None, 1)].component_id is None and not got[(None, 1)].kept
    assert minhash.near_duplicates(nothing).count() == 0
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 3, 4, 5, 8, 9]
    assert minhash.one_of_each(nothing).count() == 0


def test_bands_of_the_stage_at_its_bound():
    import inspect

    chosen = {n: p.default for n, p in inspect.signature(minhash.one_of_each).parameters.items()}
    assert (1 - (chosen["percent"] / 100) ** chosen["rows"]) ** chosen["bands"] < 2e-6


def test_minhash_of_a_large_group_against_brute_force(spark):
    """Copies with more and more changes: chains of links, pairs just above and below the bound."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    texts = [list(base)]
    for _ in range(700):
        text = list(texts[int(rng.integers(len(texts)))] if rng.random() < 0.3 else base)
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            text[at] = f"x{rng.integers(10**6)}"
        texts.append(text)
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    names = list(range(len(texts)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                names[b] = a
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, words=3, percent=85).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_language(docs, nothing):
    samples = {"en": "the cat sat on the mat and the dog barked " * 20, "de": "der hund und die katze sitzen auf der matte " * 20}
    got = {r.doc.doc_id: r.verdict for r in langid.judged(docs, samples).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[9].lang_pred == langid.UNDETERMINED and got[5].lang_score == 0
    assert all(0 <= v.lang_score <= 1 for v in got.values())
    assert langid.learned_from(nothing) == {} and langid.judged(docs, {}).first().verdict.lang_pred == langid.UNDETERMINED
    assert langid.judged(nothing, samples).count() == 0
    assert langid.Parser({"en": "abc"}).predict(["abc"])[1][0] == 1


def test_language_of_many_scripts():
    """Languages whose letters do not all have a symbol each: none is merged, and texts are told apart."""
    rng = np.random.default_rng(8)
    words = lambda a, n, k: [" ".join("".join(chr(a + c) for c in rng.integers(0, n, 3)) for _ in range(60)) for _ in range(k)]
    starts = {"ru": (0x430, 32), "ka": (0x10D0, 33), "hy": (0x561, 38), "am": (0x1200, 70), "zh": (0x4E00, 900), "zh2": (0x5E00, 900), "ko": (0xAC00, 900), "en": (0x61, 26)}
    samples = {name: " ".join(words(a, n, 12)) for name, (a, n) in starts.items()}
    parser = langid.Parser(samples)
    letters = {c for text in samples.values() for c in text if c != " "}
    assert len({parser.symbols(c).tobytes() for c in letters}) == len(letters) > 2000
    for name, (a, n) in starts.items():
        assert parser.predict(words(a, n, 5))[0] == [name] * 5
    assert all(len(t) <= 1 << 29 for t in parser.tables)


def test_parse_of_blocks_against_plain_search():
    samples = {"en": "the cat sat on the mat", "de": "der hund sass auf der matte"}
    parser, text = langid.Parser(samples), "the hund sat zzq auf the mat der"
    for at, name in enumerate(parser.names):
        left, phrases = parser.symbols(text).tobytes(), 0
        learned = parser.symbols(samples[name]).tobytes()
        while left:
            size = max((n for n in range(1, len(left) + 1) if left[:n] in learned), default=1)
            left, phrases = left[size:], phrases + 1
        want = phrases * np.log2(len(learned)) / len(parser.symbols(text))
        assert np.isclose(parser.entropies([text])[1][0, at], want)


def test_secrets(spark, nothing):
    key = "Zq8vT1xKp0Wm4sYb7NdRf2Hc"
    texts = {
        "plain words and 4929348385146306": [], f"é key {key} end": [("random", 6, 30)], f"password='{key}'": [("assign", 0, 34)],
        "sha256:" + hashlib.sha256(b"x").hexdigest(): [("hex", 7, 71)], "6f1ed002-ab5b-4d3e-9a5c-0d2f4b1c7e11": [], "AKIA" + "B7" * 8: [("access", 0, 20)],
        "secret=token:abcdefgh": [], "quarterly_report_about_2024_results": [],
    }
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, found string, clean string")
    got = {r.text: [tuple(s) for s in r.s] for r in rows.select("text", secret_scan.find("text").alias("s")).collect()}
    assert got == texts
    hidden = rows.select("text", secret_scan.redacted("text", secret_scan.find("text")).alias("t")).where("doc_id = 1").first()
    assert hidden.t == "é key <secret> end"
    assert nothing.select(secret_scan.find("text")).count() == 0


def test_secrets_of_any_length_and_letters():
    import random

    import public_tokenizers

    ranks, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper()
    key = lambda n: draw(mixed + "0123456789+/", n)
    found = lambda text: [(s["kind"], s["start"], s["end"]) for s in secret_scan.spans(text, ranks, 2.0)]
    for run in (key(683), key(1600), key(3100), key(100_000), draw(mixed, 20), draw(mixed, 16), draw(mixed, 700), draw(lower, 40), key(16), key(19)):
        assert found(f"a {run} b") == [("random", 2, 2 + len(run))]
    hexes, rest = "0123456789abcdef01234567", "Zq8vT1xKp0Wm4sYb7NdRf2HZ"
    assert found(f"a {hexes}{rest} b") == [("hex", 2, 26), ("random", 26, 50)]
    assert found(f"a {rest}{hexes} b") == [("random", 2, 26), ("hex", 26, 50)]
    assert found(f"<img src='data:image/png;base64,{key(2000)}'>") == []
    for words in ("einpfauaueinchpf", "keitstlichschenverpf", "getElementsByClassName", "state-of-the-art-design", "2024-01-15T12-00-00"):
        assert found(f"a {words} b") == []


def test_spans_of_odd_documents(docs):
    assert all(r.s == [] for r in docs.select(secret_scan.find("text").alias("s")).collect())


def test_mixing_levels(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "1", 5), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_plans(leaves, (1, 2), 1, {}).collect()}
    # Of 557 tokens a can take 115 only; its sources fill up and b gets the rest.
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 5, ("b", "x", "1"): 442}
    small = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_plans(leaves, (1, 10), 1, {}).collect()}
    # a gets 55: y has 5 of its 27, so x gets 50, and of these source 1 has 10 of its 25.
    assert small == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "1"): 5, ("b", "x", "1"): 55}


def test_mixing(docs, nothing):
    settings = dict(domain=F.lit("d"), tokens=mixing.word_count("text"), share=(2, 1), epochs=2, weights={"source": {"src1": 0}})
    got = mixing.copies(docs, **settings).collect()
    assert len(got) == docs.count() and {r.source for r in got} == {"", "src1"}
    assert all(r.copies == 0 for r in got if r.source == "src1") and all(r.copies == 2 for r in got if r.source == "")
    assert mixing.copies(nothing, **settings).count() == 0 and mixing.mixed(nothing, **settings).columns == nothing.columns
    twice = mixing.mixed(docs, **settings).collect()
    assert [r.doc_id for r in twice] == [2, 2]


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(3)
    for size in (1, 5, 200):
        demand = {int(k): int(n) for k, n in zip(rng.integers(1, 257, size), rng.integers(1, 5000, size), strict=True)}
        chosen, held = packing.patterns(demand, 256), {}
        for use, times in chosen:
            assert sum(k * n for k, n in use.items()) <= 256 and times > 0
            for k, n in use.items():
                held[k] = held.get(k, 0) + n * times
        assert held == demand
        least = sum(k * n for k, n in demand.items()) / 256
        assert sum(t for _, t in chosen) >= least
    assert packing.patterns({}, 256) == []


def test_packing(docs, nothing):
    got = packing.pack(docs).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got[got.doc_id == 5].length.tolist() == [1] and (got[got.doc_id == 6].start == 0).sum() == 2
    assert packing.pack(nothing).count() == 0


def test_ids_of_odd_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ids = Tokenizer.from_file(path), packing._ids(path)
    assert ids.by_words
    parts = [part for code in range(33, 0x260) for part in (chr(code), f"a{chr(code)}", f"{chr(code)}a", f"Ab{chr(code)}c's")]
    for group in (parts, parts[::-1], [" ".join(parts)]):
        assert [found.tolist() for found in ids.of(group)] == [tokenizer.encode(part, add_special_tokens=False).ids for part in group]
    assert ids.of([None, "", "a"])[0].tolist() == ids.of([None, "", "a"])[1].tolist() == []
    for text in ("a\x1cb  c d", "İΣ's re've x", "<|endoftext|> x<|endoftext|>y", "é ́e", "\t\n", "12a34 !?…é", "ÀÉÎßſİx ÿ¿¡ªº²", "don't I'LL x" + "y" * 300):
        assert ids.of([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_imatch(docs, nothing):
    got = {r.doc_id: r for r in imatch.compared(docs.where("doc_id IS NULL OR doc_id <> 6 OR text IS NOT NULL")).collect()}
    assert imatch.compared(docs).count() == docs.count()
    assert got[1].fingerprint == got[6].fingerprint and got[4].fingerprint == got[5].fingerprint and got[5].n_chars == 0
    assert got[5].near_next == 1 and all(0 <= r.near_edited <= 1 for r in got.values())
    assert imatch.compared(nothing).count() == 0
    alone = imatch.compared(docs.where("doc_id = 3")).first()
    assert alone.near_next == 1


def test_url_filter(spark):
    html = '<a href="https://Bad.example/x">1</a><a href=//mid.test/?q>2</a><a href="/own">3</a>'
    rows = [(1, "https://A.B.org:80/x?q#f", html), (2, None, None), (3, "no scheme", ""), (4, "http://org", None), (5, "http://example.org/es/1", None), (6, "HTTP://WWW.EXAMPLE.ORG/en/12?a", None),
            (7, "http://bad.com/de/", None), (8, "http://links.net", '<a href="http://bad.com/">'), (8, "http://links.net", None), (9, "http://x.com/fr/#/", None)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, known string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(pages).collect()}
    assert got[1] == ("a.b.org:80", "/x", None, "allow") and got[2] == got[3] == ("", "", None, "allow") and got[4] == ("org", "", None, "allow")
    assert got[5] == ("example.org", "/es/1", "example.org/es/", "block") and got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("com/de/", "block")
    assert got[8] == ("links.net", "", None, "block") and got[9][2:] == ("com/fr/", "allow")
    assert url_filter.judged(pages).count() == 10 and url_filter.judged(pages.limit(0)).count() == 0
    edges = {(r.a, r.b): r.weight for r in url_filter.host_edges(pages).collect()}
    assert edges[("a.b.org:80", "bad.example")] == 1 and edges[("a.b.org:80", "mid.test")] == 1 and edges[("www.example.org", "example.org")] == 1


def test_url_filter_follows_long_chains(spark):
    link = lambda b: f'<a href="http://{b}/">'
    rows = [(n, f"http://h{n}.net/", link(f"h{n + 1}.net" if n < 20 else "bad.com")) for n in range(21)] + [(21, "http://bad.com/de/", None), (22, "http://good.com/fr/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages).collect()}
    assert got == {n: "allow" if n == 22 else "block" for n in range(23)}


def test_ranks_against_plain_iteration(spark):
    """A cycle, a host without further edges, weights, and a seed without edges."""
    links = [("a", "b", 1.0), ("b", "c", 3.0), ("c", "a", 1.0), ("b", "end", 1.0), ("end2", "a", 2.0)]
    weights, damping = {"a": 3.0, "alone": 1.0}, 0.85
    seed = {h: w / 4 for h, w in weights.items()}
    edges = spark.createDataFrame([("k", *e) for e in links] + [("other", b, a, w) for a, b, w in links], "kind string, a string, b string, weight double")
    seeds = spark.createDataFrame([(k, h, w) for k in ("k", "other") for h, w in weights.items()], "kind string, host string, weight double")
    got = {(r.kind, r.host): r["rank"] for r in url_filter.propagated(edges, seeds).collect()}
    for kind, own in (("k", links), ("other", [(b, a, w) for a, b, w in links])):
        rank = dict(seed)
        for _ in range(300):
            out = {a: sum(w for x, _, w in own if x == a) for a, _, _ in own}
            back = 1 - damping + damping * sum(r for h, r in rank.items() if h not in out)
            new = {h: back * s for h, s in seed.items()}
            for a, b, w in own:
                new[b] = new.get(b, 0.0) + damping * rank.get(a, 0.0) * w / out[a]
            rank = new
        for host, value in rank.items():
            assert abs(got.get((kind, host), 0.0) - value) < 1e-5
        assert abs(sum(v for (k, _), v in got.items() if k == kind) - 1) < 1e-9


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ü b", "<p>x</p>"), (7, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (5, "u", "é" * 300_000), (5, "u", "z"), (9, "r", "twice"), (9, "r", "twice"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, shard string, plan int")
    folders = [f"{tmp_path}/{n}" for n in ("a", "b")]
    for folder, parts in zip(folders, (1, 5), strict=True):
        warc.write(pages.repartition(parts), folder, shard_bytes=2000, roll_bytes=600)
    digest = lambda folder: sorted((r.file, r.sha1, r.bytes) for r in spark.read.parquet(f"{folder}/_manifest").collect())
    assert digest(folders[0]) == digest(folders[1]) and len(digest(folders[0])) > 3
    got = warc.read(spark, folders[0]).collect()
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert len(got) == 9 and kinds[("7", 8)] == ("response", None) and kinds[("3", 8)] == kinds[(None, 8)] == ("revisit", "7")
    assert kinds[("2", 0)] == ("response", None) and kinds[("1", 0)] == ("revisit", "2") and sorted(r.record_type for r in got if r.page_id == "9") == ["response", "revisit"]
    assert kinds[("5", 600_000)][0] == "response" and next(r for r in got if r.payload_bytes == 600_000).payload.decode() == "é" * 300_000
    assert next(r for r in got if r.page_id == "2").payload_digest == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    first = sorted(tmp_path.glob("a/*.warc.gz"))[0]
    assert gzip.decompress(first.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    first.write_bytes(first.read_bytes()[:-1])
    with pytest.raises(ValueError, match="differ"):
        warc.read(spark, folders[0])
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_shards_and_files_follow_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 20)
    draw = np.random.default_rng(4)
    rows = [(i, "u", draw.bytes(3000).hex()) for i in range(120)] + [(7, "same", "page")] * 205 + [(8, None, "page"), (7, "other", "page"), (9, "large", draw.bytes(200_000).hex())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w", shard_bytes=60_000, roll_bytes=20_000)
    manifest = spark.read.parquet(f"{tmp_path}/w/_manifest").toPandas()
    assert manifest.records.sum() == len(rows) and manifest["shard"].nunique() > 5
    whole = manifest[manifest.part < manifest.groupby("shard").part.transform("max")]
    assert len(whole) > 5 and (whole.bytes >= 20_000).all() and (manifest.bytes < 20_000 + 250_000).all()
    assert (manifest.groupby("shard").bytes.sum() < 60_000 * 4 + 250_000).all()
    got = warc.read(spark, f"{tmp_path}/w").toPandas()
    same = got[got.payload_bytes == 4]
    assert len(same) == 207 and (same.record_type == "response").sum() == 1 and set(same[same.record_type == "revisit"].refers_to) == {"8"}
    assert sorted(got.page_id) == sorted(str(r[0]) for r in rows)


def test_reading_an_archive_is_linear():
    def seconds(n):
        member = gzip.compress(warc.page_record("1", "u", warc.base32_sha1(b"x" * 500), 500, 0, None, b"x" * 500, warc.DATE), 1)
        data = member * n
        start = time.process_time()
        assert sum(1 for _ in warc.records(data)) == n
        return time.process_time() - start

    seconds(2000)
    assert seconds(40_000) < 16 * max(seconds(5000), 0.05)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(gzip.compress(warc.record("warcinfo", [], b"x"))[:-3]))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 4)) * rng.uniform(0.5, 2, (40, 1)))]
    rows += [(100 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(50)] + [(201, None), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]), (205, [float("inf"), 1.0, 0.0, 0.0]), (206, [1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, number string")
    good = {i: np.array(v) for i, v in rows if i is not None and i < 200}
    got = ann.neighbours(table, F.col("vec_id") % 10 == 0, k=5, block=16, query_block=4, confidence=0.999999).toPandas()
    for query in [i for i in good if i % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(good[query], v, strict=True)), i) for i, v in good.items() if i != query)[:5]
        mine = got[got.query_id == query].sort_values("rank")
        assert mine.vec_id.tolist() == [i for _, i in scores] and np.allclose(mine.score, [-s for s, _ in scores])
    assert set(got.query_id) == {i for i in good if i % 10 == 0}
    assert ann.neighbours(table.limit(0), F.lit(True)).count() == 0 and ann.neighbours(table, F.lit(None).cast("boolean")).count() == 0
    assert ann.neighbours(table.where("vec_id < 3"), F.lit(True)).count() == 6


def test_chi_square():
    assert np.allclose(ann.chi_square_cdf(np.array([0.0, 7.344, 13.362, 20.09]), 8), [0, 0.5, 0.9, 0.99], atol=1e-3)


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, None, None), (2, 0, "assistant", ""), (None, 3, "a: b", "x"), (4, 0, "assistant", "l" * 200_000)]
    rows += [(5, t, "assistant" if t % 2 else "user", f"turn {t} \\\\ ### :") for t in range(100)] + [(5, 7, "assistant", f"turn 7 {chr(0x1A)}")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, block string")
    blocks = chat.formatted(table, window=8)
    got = {r.conv_id: r for r in chat.digests(blocks).collect()}
    for conv in (1, 2, None, 4, 5):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv].n_turns == len(own) and not got[conv].rewrites
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
        assert got[conv].formatted_chars == len(chat.render([(r, x) for _, r, x in own]))
    assert chat.digests(chat.formatted(table.limit(0))).count() == 0
    text, spans = chat.located([("user", "a"), ("assistant", "b")], [], lambda turns: "".join(t.upper() for _, t in turns[:-1]) + "".join(t for _, t in turns[-1:]))
    assert not spans[0]["rewrites"] and spans[1]["rewrites"] and not spans[1]["loss"] and text == "Ab"


def test_chat_of_templates_that_look_far_back(spark):
    def system_in_last_user(turns):
        system = "".join(t for r, t in turns if r == "system")
        if turns and turns[0][0] == "assistant":
            raise ValueError("an assistant turn comes first")
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{r}>{system if i == last else ''}{t}\n" for i, (r, t) in enumerate(turns) if r != "system")

    def hides_far_thoughts(turns):
        return "".join(f"<{r}>{t if len(turns) - i < 40 or r != 'assistant' else '-'}\n" for i, (r, t) in enumerate(turns))

    def counted(turns):
        return "".join(f"<{r} {i}>{t}\n" for i, (r, t) in enumerate(turns))

    said = [("system", "be brief. ")] + [("assistant" if t % 2 else "user", f"said {t}") for t in range(80)]
    convs = {1: said, 2: said[1:]}
    table = spark.createDataFrame([(c, n, *t) for c, turns in convs.items() for n, t in enumerate(turns)], "conv_id long, turn int, role string, text string")
    for template, rewrites in ((system_in_last_user, {1: True, 2: False}), (hides_far_thoughts, {1: True, 2: True}), (counted, {1: False, 2: False})):
        rows = chat.formatted(table, template).orderBy("conv_id", "block").collect()
        for conv, turns in convs.items():
            own = [r for r in rows if r.conv_id == conv]
            assert [r.first_turn for r in own] == [0, 32, 64]
            assert "".join(r.text for r in own) == template(turns)
            assert [s.turn for r in own for s in r.spans] == list(range(len(turns)))
            assert any(s.rewrites for r in own for s in r.spans) == rewrites[conv]
            for r in own:
                for s in r.spans:
                    assert not s.loss or r.text[s.text_start : s.text_end] == turns[s.turn][1]
                    assert s.loss or rewrites[conv] or turns[s.turn][0] != "assistant"
    assert chat.formatted(table, counted, context=40).count() == 6


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, nothing, stage):
    name, work = corpus_pipeline.STAGES[stage]
    got = work(spark, docs, "/nowhere")
    rows = got.collect()
    assert work(spark, nothing, "/nowhere").count() == 0
    if name != "packing":
        assert got.columns == docs.columns
    if name == "language":
        assert {r.doc_id for r in rows} == {1, 2, 3, 6, None, 8}
    if name == "near_copies":
        assert len(rows) == 7
    if name == "secrets":
        assert len(rows) == docs.count()
    if name in ("mixture", "packing"):
        assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, None, 8, 9}


def test_language_stage_without_labels_keeps_all(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "/nowhere").count() == docs.count()


def test_queries_cover_the_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_imatch_goes_on_with_short_columns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(imatch, "checkpointed", lambda df: written.append(dict(df.dtypes)) or df.localCheckpoint())
    rows = spark.createDataFrame([(i, f"common {'abcde'[i % 5]}x {'fgh'[i % 3]}y") for i in range(60)] + [(7, "..."), (None, None)], "doc_id long, text string")
    got = imatch.compared(rows, rare=10, common=1).collect()
    assert len(got) == 62 and all(len(r.edited_sha256) == 64 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got}) > 10 and any(r.fingerprint.count("-") == len(imatch.SUBSETS) - 1 for r in got)
    prints = written[-1]
    assert prints["digest"] == "binary" and prints["own"] == prints["other"] == "string" and "key" not in prints and "next_key" not in prints
    plan = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert imatch.lexicon(rows, rare=10, common=1) != imatch.lexicon(plan) == [""] * 16**imatch.LINE


def test_imatch_looks_at_few_terms_for_its_narrow_subsets(spark):
    """Fingerprints as written out in Python; narrow subsets and the lexicon are asked without a look at each term of each subset."""
    import re

    for bound, what in imatch.SHOWN.items():
        assert all(re.search(what, f"{pair:02x}") for pair in range(256) if f"{pair:02x}" < bound)
    draw = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 8)) for _ in range(3000)]
    texts = [" ".join(words[w] for w in draw.integers(0, 3000, 400)) for _ in range(40)] + ["once alone", "..."]
    plan = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = imatch.lexicon(plan, common=2)
    found = plan.select("doc_id", imatch.written(imatch.parts(F.col("text"), table)).alias("print"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    terms = [sorted({md5(t) for t in re.split("[^a-z]+", text) if t}) for text in texts]
    counts = {d: sum(d in own for own in terms) for own in terms for d in own}
    for (_, got), own in zip(sorted(found.collect()), terms, strict=True):
        known = [d for d in own if 2 <= counts[d] <= len(texts) // 2]
        members = [[d for d in known if d[k : k + 2] < bound] for k, bound in enumerate(imatch.SUBSETS)]
        assert got == ("-".join(md5("".join(m))[:8] if m else "" for m in members) if known else "*" + md5("".join(own)))
    asked = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in asked and "conv(" not in asked and "rlike" in asked.lower()


def test_warc_digests_are_shuffled_as_bytes(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(warc, "checkpointed", lambda df: written.append(dict(df.dtypes)) or df.localCheckpoint())
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert all(types["sha"] == types["sha1"] == "binary" for types in written) and len(written) >= 2


def test_packing_encodes_in_bounded_memory():
    import tracemalloc

    import public_tokenizers

    draw = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in draw.integers(0, 26, 7)) for _ in range(20_000)])
    texts = [" ".join(words[draw.integers(0, 20_000, 300)]) for _ in range(2000)]
    ids = packing._ids(public_tokenizers.path("word_bpe_49k.json"))
    ids.forget()
    tracemalloc.start()
    for at in range(0, len(texts), packing.BATCH):
        for _, group in packing.text_groups(texts[at : at + packing.BATCH], packing.GROUP):
            ids.of(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak


def test_packing_encodes_a_word_once(monkeypatch):
    """Words are remembered though each comes once in its group of texts; those that come up most stay when there are too many."""
    import public_tokenizers

    ids = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    draw = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 7)) + mark for mark in ("", "!!", "%%%", ",***", "?!") for _ in range(200)]
    texts = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)]
    exact, asked = ids._exact(texts), []
    cut = ids._cut
    monkeypatch.setattr(ids, "_cut", lambda rows: asked.extend(rows) or cut(rows))
    ids.forget()
    assert [found.tolist() for found in ids.of(texts)] == exact and asked
    asked.clear()
    monkeypatch.setattr(ids, "cut", lambda part: pytest.fail(f"{part} was cut with the pattern"))
    assert [found.tolist() for found in ids.of(texts)] == exact and not asked
    monkeypatch.setattr(packing, "KNOWN", 120)
    for at in (0, 1, 0, 5, 0, 9, 3):
        assert [found.tolist() for found in ids.of([texts[0], texts[at]])] == [exact[0], exact[at]]
        assert len(ids.known) <= 120 and len(ids.first) == len(ids.known) + 1 == len(ids.uses) + 1
    assert sum(word in ids.known for word in texts[0].split()) > 50
