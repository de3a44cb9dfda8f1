"""Repair of conversation structure by dynamic programming over a secondary-sorted stream.

A well-formed conversation is ``(s?(ua)+)?`` in the initials of its roles. The cheapest edits (Keep, Rerole,
Delete, Insert) that make a conversation well-formed are found over four states: nothing yet, after the system
turn, after a user turn, after an assistant turn. Costs to go are carried backwards from the last row, so that
ties can be broken by the first letter in which two audits differ: in a state each letter leads to one next
state, so the least letter of a cheapest edit begins the least audit.

Rows are partitioned by conversation and sorted, each twice: first backwards without text, then forwards
with it. One pass of ``mapInPandas`` carries the state over Arrow batches: backwards it keeps the costs of four
states and pushes one byte a row, the choice in each state, to a spool that goes to disk for giant
conversations; forwards it reads the bytes from the end, writes the audit and hashes the repaired turns. No
conversation is held in memory, whatever its length, but its audit of about a character a row.

A row's fault is the first of: blank, duplicate of an earlier row (role and text), truncated.

Defined results: null roles and texts are one space, so such a row has no role that could stay; an empty text
is blank. Rows go by turn, null turns first, then by role and text. Rows of a null conversation id are one
conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Bytes of choices in memory before a conversation's spool goes to disk, and bytes read back at once.
SPOOL, PAGE = 1 << 20, 1 << 16
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads, and which it is.
NEXT, ADDED = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
LETTERS = "DIKR"
LEGAL = ("su", "ua", "au")
#: Costs to go behind the last row: the turns that are inserted there.
END = (0, 2 * INSERT, INSERT, 0)
WHITE = " \t\n\x0b\x0c\r"

Row = tuple[str, int]  # initial of the role, fault: 0 none, 1 blank or duplicate, 2 truncated


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def step(after: tuple[int, ...], row: Row) -> tuple[tuple[int, ...], int]:
    """Costs to go before a row from those after it, and the choices in its four states, two bits each."""
    initial, fault = row
    more = CUT if fault == 2 else 0
    options: list[dict[str, int]] = []
    for state in range(4):
        cost = {"D": DELETE + after[state]}
        if fault != 1:
            cost["R"] = REROLE + more + after[NEXT[state]]
            stays = kept_state(state, initial)
            if stays is not None:
                cost["K"] = KEEP + more + after[stays]
        options.append(cost)
    least = [min(o.values()) for o in options]
    # Two inserted turns in a row lead from an assistant turn to an assistant turn, so one round is enough for users and assistants.
    ahead = [0, 0, min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])]
    before, choice = [], 0
    for state, cost in enumerate(options):
        cost["I"] = INSERT + ahead[NEXT[state]]
        before.append(min(cost.values()))
        choice |= LETTERS.index(min(k for k, v in cost.items() if v == before[-1])) << 2 * state
    return tuple(before), choice


class Costs:
    """Costs to go, carried as (least, difference of each state); there are few differences, so steps are looked up."""

    def __init__(self):
        self.known: dict[tuple[tuple[int, ...], Row], tuple[tuple[int, ...], int, int]] = {}

    def back(self, base: int, rest: tuple[int, ...], row: Row) -> tuple[int, tuple[int, ...], int]:
        found = self.known.get((rest, row))
        if found is None:
            before, choice = step(rest, row)
            found = tuple(c - min(before) for c in before), min(before), choice
            self.known[rest, row] = found
        return base + found[1], found[0], found[2]


class Conversation:
    """What is known of the conversation that streams by."""

    def __init__(self, key):
        self.key, self.base, self.rest = key, 0, END
        self.spool, self.pushed = tempfile.SpooledTemporaryFile(max_size=SPOOL), 0  # noqa: SIM115
        self.page, self.state = bytearray(), START
        self.faults, self.illegal, self.gaps = [0, 0, 0, 0], 0, 0
        self.first = self.last = self.before = None
        self.turns = 0
        self.audit, self.digest, self.written = bytearray(), hashlib.sha256(), False

    def backwards(self, costs: Costs, rows: Sequence[Row]) -> None:
        choices = bytearray()
        for row in rows:
            self.base, self.rest, choice = costs.back(self.base, self.rest, row)
            choices.append(choice)
        self.spool.write(choices)
        self.pushed += len(choices)

    def choice(self) -> int:
        if not self.page:
            start = max(0, self.pushed - PAGE)
            self.spool.seek(start)
            self.page, self.pushed = bytearray(self.spool.read(self.pushed - start)), start
        return self.page.pop()

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written = True

    def insert(self) -> None:
        self.audit += b"I"
        self.say(ADDED[self.state], "")
        self.state = NEXT[self.state]

    def forwards(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        choices = self.choice()
        while (letter := LETTERS[choices >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += letter.encode()
        if letter == "R":
            self.say(ADDED[self.state], text)
            self.state = NEXT[self.state]
        elif letter == "K":
            self.say(role, text)
            self.state = kept_state(self.state, initial)

    def end(self) -> tuple:
        for _ in range(END[self.state] // INSERT):
            self.insert()
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        self.spool.close()
        _, blank, duplicate, truncated = self.faults
        return self.key, gaps, blank, duplicate, truncated, self.illegal, self.base + self.rest[START], self.audit.decode(), self.digest.hexdigest()


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = ["key", *[c.split()[0] for c in COLUMNS.split(", ")]]


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by conversation and pass: one row per conversation."""
    costs, current, done = Costs(), None, []
    for batch in batches:
        for start, end in _runs(batch["id"].to_numpy(), batch["no_id"].to_numpy(), batch["pass"].to_numpy()):
            part = batch.iloc[start:end]
            key = None if part["no_id"].iat[0] else int(part["id"].iat[0])
            if current is None or current.key != key:
                if current is not None:
                    done.append(current.end())
                current = Conversation(key)
            way = part["pass"].iat[0]
            if way == 1:
                faults = np.array([0, 1, 1, 2])[part["fault"].to_numpy()].tolist()
                current.backwards(costs, list(zip(part["initial"], faults, strict=True)))
            elif way == 2:
                turns = [None if none else turn for turn, none in zip(part["turn"].tolist(), part["no_turn"].tolist(), strict=True)]
                for row in zip(turns, part["role"], part["text"], part["fault"].tolist(), strict=True):
                    current.forwards(*row)
        if len(done) >= 1000:
            yield _table(done)
            done = []
    if current is not None:
        done.append(current.end())
    if done:
        yield _table(done)


def _table(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(done, columns=_COLUMNS).astype({"key": "Int64"})


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1).tolist()
    if len(keys[0]):
        yield from zip([0, *edges], [*edges, len(keys[0])], strict=True)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with seeded faults: key, turn, role, text, copies (0 for a row that is dropped).

    By the CRC of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 makes its role ``user``.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conv_id).cast("long").alias("key"), F.col(turn).cast("long").alias("turn"),
        F.when(lot == 4, "user").otherwise(spaced(role)).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(spaced(text), ".!?", "")).otherwise(spaced(text)).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def as_given(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows without seeded faults: key, turn, role, text, copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_id).cast("long").alias("key"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(1).alias("copies"))


def repaired(rows: DataFrame, faults: Callable[..., DataFrame] = as_given, **columns: str) -> DataFrame:
    """Per conversation: key (its id), its faults, the least cost, the audit and the hash of the repaired turns.

    ``faults`` gives the rows as key, turn, role, text and copies: ``as_given``, or ``damaged`` for seeded faults.
    """
    of = ["id", "no_id"]  # a null id is told from 0 and stays a whole number
    given = faults(rows, **columns).withColumns({"id": F.coalesce("key", F.lit(0)), "no_id": F.col("key").isNull()}).repartition(*of)
    copies = given.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))))
    gone = F.col("copy") == 0
    at = F.row_number().over(Window.partitionBy(*of).orderBy(gone, F.asc_nulls_first("turn"), "role", "text", "copy"))
    again = F.row_number().over(Window.partitionBy(*of, "role", "text").orderBy(gone, "at")) > 1
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(body == "", 1).when(F.col("again"), 2).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    told = copies.withColumn("at", at).withColumn("again", again).withColumn("fault", fault)
    both = told.withColumn("pass", F.explode(F.when(gone, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    second = F.col("pass") == 2
    both = both.select(
        *of, "pass", F.when(second, F.col("at")).otherwise(-F.col("at")).alias("at"), F.substring("role", 1, 1).alias("initial"), "fault",
        F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), *[F.when(second, F.col(c)).alias(c) for c in ("role", "text")],
    )
    return both.sortWithinPartitions(*of, "pass", "at").mapInPandas(_streamed, f"key long, {COLUMNS}")
