"""Token alignment against brute force on whole tables, and its defined results."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

import __spark_entry__ as entry
from logloom.llm import align

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def parts(tools, text):
    """(A ids, A bytes, B ids, B bytes) of a text by whole-text encoding."""
    a, b = tools
    spans = list(map(chr, range(256)))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    assert len(byte) == len(spans)
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    return a_ids, a_bytes, b_ids, b_bytes


def brute(tools, docs):
    """Rows of the contract, by sets of offsets and all links written out."""
    rows, held = {}, Counter()
    for key, text in docs:
        rows[key] = groups = []
        if not text:
            continue
        a_ids, a_bytes, b_ids, b_bytes = parts(tools, text)
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        i = j = 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a_ids[i:x], b_ids[j:y]))
            i, j = x, y
        held.update({p for x, y in groups for p in product(x, y)})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = {}
    for key, groups in rows.items():
        links = [p for x, y in groups for p in product(x, y)]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[key] = (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        )
    return out


def as_rows(frame, last):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, getattr(r, last)) for r in frame.itertuples()}


def test_query_against_brute_force(spark, tools):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = entry.queries()["op11_alignment"](spark, FOLDER).toPandas()
    assert as_rows(got, "groups_sha256") == brute(tools, docs) and len(got) == len(docs)


ODD = [
    "", " ", "  ", "   x", "x ", "x  ", " x", "a  b", "a\n b", "a \n b", "\t\t a  b", "a▁b", "▁", " ▁ ", "<s> </s> <unk> <0x41>", "<|endoftext|> x",
    "it's  they'll 's 's", "naïve ﬁ 東京 タワー привет 🙂🙂 🏳️‍🌈", "\x00 \x1c \x1d x\x1e y", "a  b\u0085 c", "x" * 5000, "ab " * 3000, "🙂" * 700, " " * 3000, "\n" * 999 + " x",
    "0123456789" * 300, "a.b.c...d!!! ??", "​‌ x ﻿ y", "é 가",
]


def drawn():
    draw = random.Random(7)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "'s", "1", "é", "東", "🙂", " ", "▁", "<s>", ".", "　", "ing", "\x1f"]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(400)]


def test_odd_texts_with_lanes_and_blocks(spark, tools):
    texts = [*ODD, *drawn(), None, "the end", "the end"]
    docs = list(enumerate(texts))
    wanted = brute(tools, docs)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, block string").repartition(3)
    for block in (1, 2000, align.BLOCK):
        got = align.linked(frame, block=block).toPandas()
        rows = {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest() if v[-1] else "") for k, v in as_rows(got, "groups").items()}
        assert rows == wanted
    assert wanted[texts.index(None)] == wanted[0] == (0, 0, 0, 0, 0, 0, "") and wanted[texts.index("▁")][0] == 0


def test_cuts_are_those_of_whole_documents(spark, tools):
    docs = [(1, "naïve 東京 tower"), (2, None), (3, "x" * 3000)]
    for row in align.aligned(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = dict(docs)[row.doc_id]
        if text is None:
            assert not row.a_ids and not row.a_cuts
            continue
        a_ids, a_bytes, b_ids, b_bytes = parts(tools, text)
        assert (row.a_ids, row.b_ids) == (a_ids, b_ids)
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(a_ends) & set(b_ends))
        assert [a_ends[c - 1] for c in row.a_cuts] == cuts == [b_ends[c - 1] for c in row.b_cuts]


@pytest.mark.parametrize("lane", [1, 7, 64, 10**6])
def test_lockstep_against_sets(lane):
    draw = np.random.default_rng(lane)
    for _ in range(50):
        a_ends, b_ends, docs, at = [], [], [0], 0
        for _ in range(draw.integers(1, 6)):
            size = int(draw.integers(0, 200))
            if size:
                a_ends += sorted({at + size, *(at + 1 + draw.choice(size, draw.integers(0, size), replace=False)).tolist()})
                b_ends += sorted({at + size, *(at + 1 + draw.choice(size, draw.integers(0, size), replace=False)).tolist()})
                at += size
            docs.append(len(a_ends))
        a, b = align.lockstep(np.array(a_ends, np.int64), np.array(b_ends, np.int64), np.array(docs[1:], np.int64), lane)
        cuts = sorted(set(a_ends) & set(b_ends))
        assert [a_ends[i - 1] for i in a] == cuts == [b_ends[i - 1] for i in b]


def test_long_groups_are_counted_without_writing_links_out(monkeypatch, spark, tools):
    docs = [(1, "🙂" * 40 + "東京" * 9), (2, "x" * 400)]
    wanted = brute(tools, docs)
    monkeypatch.setattr(align, "SMALL", 2)
    aligner = align.Aligner(*align._paths(None, None))
    block = aligner.block([t for _, t in docs])
    doc, _, links = block.pairs(len(aligner.b.tokens))
    assert [int(links[doc == i].sum()) for i in range(2)] == [wanted[k][3] for k, _ in docs]


def test_empty_table_and_clashing_columns(spark):
    columns = "doc_id long, text string, places int, at string, n long, pair string"
    assert align.linked(spark.createDataFrame([], columns)).collect() == []
    rows = align.linked(spark.createDataFrame([(None, "a b", 1, "x", 2, "p"), (5, "a b", 1, "x", 2, "p")], columns)).collect()
    assert sorted((r.doc_id is None, r.n_a, r.groups) for r in rows) == sorted((n, rows[0].n_a, rows[0].groups) for n in (False, True))
