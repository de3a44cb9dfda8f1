"""The registered queries of the training-data operators against SQL or brute force, over whole tables."""

import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logloom.llm import queries, secret_scan

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.fixture(scope="module")
def result(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = entry.queries()[name](spark, FOLDER).toPandas()
        return known[name]

    return get


def shown(value):
    if value is None or str(value) in ("nan", "<NA>", "None"):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(result, duck, name):
    got, want = result(name), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda t: sorted(tuple(map(shown, r)) for r in t[columns].itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("module", ["url_filter", "imatch"])
def test_native_operators_have_no_python_functions(module):
    with open(f"{entry.__file__.rpartition('/')[0]}/logloom/llm/{module}.py") as source:
        assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas", source.read())


def test_secrets_against_brute_force(result, duck):
    got = result("op2_secrets").set_index("doc_id")
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
        row = got.loc[doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        wanted = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base)]
        assert [s for s in row.spans.split(",") if s and not s.startswith("random")] == wanted


def test_language_of_held_out_documents(result, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = result("op7_language")
    assert sorted(got.doc_id) == sorted(lang)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert np.mean([lang[i] == p for i, p in zip(held.doc_id, held.lang_pred, strict=True)]) > 0.97
    assert got.score.between(0, 1).all()


def test_neighbours_against_brute_force(result, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got, hits, total = result("op9_neighbours"), 0, 0
    for query in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == query][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        mine = got[got.query_id == query].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(order) + 1)) and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, [scores[ids == i][0] for i in mine.vec_id], atol=1e-12)
        hits, total = hits + len(set(mine.vec_id) & set(ids[order])), total + len(order)
    assert hits / total >= 0.9


def _packed_right(got, texts, repeated=False):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == doc_id].sort_values("start")
        copies = int((mine.start == 0).sum())
        assert copies == 1 or repeated
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == copies * len(ids)
        for row in mine.itertuples():
            assert zlib.crc32(ids[row.start : row.start + row.length].tobytes()) == row.ids_crc32
        if copies == 1:
            assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048


def test_packing_against_the_tokenizer(result, duck):
    got = result("op10_packing")
    _packed_right(got, duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.95


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    language, unique, clean, mixed, packed = seen.values()
    assert len(language) == 200 and set(language.lang) == {"en", "de", "fr", "es"}
    assert set(unique.doc_id) <= set(language.doc_id) and unique.doc_id.is_unique and 100 < len(unique) < 200
    assert set(clean.doc_id) == set(unique.doc_id) and not any(secret_scan.base_spans(t) for t in clean.text)
    before = dict(zip(unique.doc_id, unique.text, strict=True))
    for row in clean.itertuples():
        assert row.n_chars == len(row.text) and (row.text == before[row.doc_id] or "<secret>" in row.text)
    words = lambda t: t.text.map(lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)))
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.groupby("doc_id").size().max() <= queries.EPOCHS
    assert 0.65 * words(clean).sum() < words(mixed).sum() < 0.9 * words(clean).sum()
    assert set(packed.doc_id) == set(mixed.doc_id)
    _packed_right(packed, dict(zip(mixed.doc_id, mixed.text, strict=True)).items(), repeated=True)


def test_run_is_the_stages(spark):
    assert entry.queries()["pipeline"](spark, FOLDER).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
