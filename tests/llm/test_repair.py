"""Conversation repair against a search over all edits, on whole tables and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from logloom.llm import repair

FOLDER = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def harmed(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, turns) over all edits, by a search over roles so far; written apart from the operator."""
    found = faults(rows)


    # Inserted turns: relaxed until nothing changes.
    table = {}
    for at in range(len(rows), -1, -1):
        now = {}
        for last in ("", "s", "u", "a"):
            now[last] = None
        for _ in range(6):
            for last in now:
                after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                options = []
                if at == len(rows):
                    if last in ("", "a"):
                        options.append((0, "", ()))
                else:
                    _, role, text = rows[at]
                    cost, audit, turns = table[at + 1, last]
                    options.append((2 + cost, "D" + audit, turns))
                    if found[at] not in ("blank", "duplicate"):
                        more = 5 if found[at] == "truncated" else 0
                        if role[:1] and role[:1] in after:
                            cost, audit, turns = table[at + 1, role[:1]]
                            options.append((more + cost, "K" + audit, ((role, text), *turns)))
                        for to in ("user", "assistant"):
                            if to[0] in after:
                                cost, audit, turns = table[at + 1, to[0]]
                                options.append((1 + more + cost, "R" + audit, ((to, text), *turns)))
                for to in ("user", "assistant"):
                    if to[0] in after and now[to[0]]:
                        cost, audit, turns = now[to[0]]
                        options.append((5 + cost, "I" + audit, ((to, ""), *turns)))
                if options:
                    now[last] = min(options)
        table |= {(at, last): found_ for last, found_ in now.items()}
    return table[0, ""]


def wanted(rows):
    out = {}
    for conv, kept in harmed(rows).items():
        counts = Counter(faults(kept))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = cheapest(kept)
        assert GOOD.fullmatch("".join(r[0] for r, _ in said))
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def answers(frame):
    rows = frame.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_repair"](spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert answers(got) == wanted(rows)


def drawn(n, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "bot", "Sys"]
    texts = ["Hi.", "Yes!", "no", "", " \t\n", None, "x ", "y. ", "ok?\n", "a\x0bb. \r", " ", "東。", "long " * 50 + "."]
    rows = []
    for conv in [None, *range(-3, n)]:
        for _ in range(draw.randint(0, 9)):
            rows.append((conv, draw.choice([None, *range(-2, 12), 2**60]), draw.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1, 1])[0], draw.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = drawn(150, seed)
    # A batch cuts conversations, and a small spool goes to disk.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string").repartition(5)
        assert answers(repair.repaired(frame, repair.damaged)) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_conversation_reads_its_choices_back_from_disk(monkeypatch):
    monkeypatch.setattr(repair, "SPOOL", 64)
    monkeypatch.setattr(repair, "PAGE", 16)
    draw, costs = random.Random(4), repair.Costs()
    rows = [(i, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Hi.", "no", ""]) + str(i) + draw.choice([".", ""])) for i in range(500)]
    kinds = [{"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for f in faults(rows)]
    talk = repair.Conversation(9)
    for i in range(499, -1, -1):
        talk.backwards(costs, [(rows[i][1][:1], (0, 1, 1, 2)[kinds[i]])])
    for row, kind in zip(rows, kinds):
        talk.forwards(*row, kind)
    cost, audit, said = cheapest(rows)
    assert talk.end()[6:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    assert len(costs.known) < 200  # a small automaton, whatever the length


def test_conversation_without_rows_and_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(5, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert answers(repair.repaired(frame, repair.damaged)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(frame.limit(0)).collect() == []
    assert answers(repair.repaired(frame)) == {5: (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())}
