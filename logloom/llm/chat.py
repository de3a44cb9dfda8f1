"""Chat formatting with loss masks found by incremental rendering of a black-box template.

A template is a function from a list of turns to text. To find where each turn lies, successive prefixes
of the turns are rendered and each output is compared with the one before: what was appended is the
turn's span. An output that does not begin with the one before shows that the template rewrites history,
and the turn is marked. Inside a span the text's place is found by rendering the turn once more with a
one-character probe as its text. Nothing is assumed about the template's marks.

The prefixes begin with the first turn of the conversation, whatever its length, and the blocks of
``window`` turns that come out are cuts of the whole text: joined, they are what the template makes of all
turns. Of turns whose text a later turn rewrites, the spans end where that begins, without loss. All
prefixes of a conversation are rendered in one task, at a cost with the square of its length.

For a template that is known to be local, ``context`` says how many turns it looks back. A block's prefixes
are then rendered after so many turns before it, so that long conversations are spread over tasks and cost
the window's length a turn. If such a template rewrites what lies before the block, an error is raised.

Defined results: rows are ordered by turn, then role, then text, so ties and repeated rows keep one order
each. Null role and text are empty ones. A null conversation id is a conversation. Texts of any length
are whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import no_text
from logloom.operators.indexing import with_order_index

Turn = tuple[str, str]
Render = Callable[[Sequence[Turn]], str]
WINDOW, PROBE = 32, "\x1a"
FORMATTED = "conv_id long, block long, first_turn long, text string, spans array<struct<turn:long,start:long,end:long,text_start:long,text_end:long,loss:boolean,rewrites:boolean>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"

# The template of this module: ``### role: text </turn>`` and a line end for each turn.
START, END = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|(: )")
_TEXT_END = re.compile(r"\\(?:\\|###|</turn>)|( </turn>\n)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[Turn]) -> str:
    return "".join(f"{START}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{END}" for role, text in turns)


def parse(text: str) -> Iterator[Turn]:
    """The turns that ``render`` has written."""
    at = 0

    def upto(end: re.Pattern) -> str:
        nonlocal at
        for m in end.finditer(text, at):
            if m.group(1):
                found, at = unescape(text[at : m.start()]), m.end()
                return found
        raise ValueError("the text does not end with a turn")

    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn begins without its mark")
        at += len(START)
        role = upto(_ROLE_END)
        yield role, upto(_TEXT_END)


def _shared(a: str, b: str) -> int:
    """Length of what two texts begin with alike."""
    least, most = 0, min(len(a), len(b))
    while least < most:
        middle = (least + most + 1) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            most = middle - 1
    return least


def located(turns: Sequence[Turn], context: Sequence[Turn], render_: Render, loss_role: str = "assistant") -> tuple[str, list[dict]]:
    """The text that ``turns`` add after ``context``, and each turn's span, text place, loss and rewriting mark in it.

    Without ``context`` it is the whole text.
    """
    done = list(context)
    before = render_(done)
    base = len(before) if done else 0
    spans = []
    for role, text in turns:
        now = render_([*done, (role, text)])
        rewrites = not now.startswith(before)
        start = len(before) if not rewrites else _shared(before, now)
        if rewrites:
            for span in reversed(spans):
                if span["end"] <= start - base:
                    break
                span.update({n: min(span[n], start - base) for n in ("start", "end", "text_start", "text_end")}, loss=False)
        probed = render_([*done, (role, PROBE)])
        # The probe is looked for behind what both outputs share, from the end: no earlier text can hide it.
        place = probed.rfind(PROBE)
        tail = len(probed) - place - 1
        known = not rewrites and place >= start and probed[:place] == now[:place] and now.endswith(probed[place + 1 :])
        spans.append(
            {"start": start - base, "end": len(now) - base, "text_start": (place if known else start) - base, "text_end": (len(now) - tail if known else start) - base,
             "loss": known and role == loss_role, "rewrites": rewrites}
        )
        done.append((role, text))
        before = now
    return before[base:], spans


def _formatter(render_: Render, window: int, loss_role: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, turns, lead, first = None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if turns:
                text, spans = located(turns, lead, render_, loss_role)
                if lead and any(span["start"] < 0 for span in spans):
                    raise ValueError("the template rewrites turns before the block, so it is not local")
                kind = pa.list_(pa.struct([(n, pa.bool_() if n in ("loss", "rewrites") else pa.int64()) for n in ("turn", "start", "end", "text_start", "text_end", "loss", "rewrites")]))
                cuts = [0, *[spans[n]["start"] for n in range(window, len(spans), window)], len(text)]
                for n, (cut, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = [
                        {**{k: v if isinstance(v, bool) else v - cut for k, v in span.items()}, "turn": first + n * window + m}
                        for m, span in enumerate(spans[n * window : (n + 1) * window])
                    ]
                    columns = [pa.array([here[0]], pa.int64()), pa.array([here[1] + n], pa.int64()), pa.array([first + n * window], pa.int64()), pa.array([text[cut:end]]), pa.array([own], kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "first_turn", "text", "spans"])

        for batch in batches:
            for conv, block, at, role, text in zip(*[batch[n].to_pylist() for n in ("conv_id", "block", "at", "role", "text")], strict=True):
                if (conv, block) != here:
                    yield from out()
                    here, turns, lead, first = (conv, block), [], [], block * window
                (turns if at >= first else lead).append((role, text))
        yield from out()

    return work


def formatted(
    turns: DataFrame, render_: Render = render, window: int = WINDOW, context: int | None = None, loss_role: str = "assistant",
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Per block of a conversation: conv_id, block, first_turn, text, and the spans of its turns in that text.

    ``context`` is for templates that look back so many turns only; without it, all turns before are rendered.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), no_text(role).alias("role"), no_text(text).alias("text"))
    placed = with_order_index(rows, ["turn", "role", "text"], ["conv_id"], "at")
    if context is None:
        whole = placed.select("conv_id", "at", "role", "text", F.lit(0).cast("long").alias("block"))
        ready = whole.repartition("conv_id").sortWithinPartitions("conv_id", "at")
        return ready.mapInArrow(_formatter(render_, window, loss_role), FORMATTED)
    block = F.floor(F.col("at") / window)
    # The last turns of a block lead the next one; a block of leading turns only gives nothing.
    after = F.when(F.col("at") % window >= window - context, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.select("conv_id", "at", "role", "text", F.explode(after).alias("block"))
    ready = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return ready.mapInArrow(_formatter(render_, window, loss_role), FORMATTED)


def _digester(parse_: Callable[[str], Iterator[Turn]], unescape_: Callable[[str], str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if state is not None:
                n, turns, chars, loss, size, rewrites = state
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
                values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                key, text = batch["conv_id"][at].as_py(), batch["text"][at].as_py()
                if state is None or key != conv:
                    yield from out()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, said in parse_(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in batch["spans"][at].as_py():
                    state[5] |= span["rewrites"]
                    if span["loss"]:
                        said = unescape_(text[span["text_start"] : span["text_end"]])
                        state[2] += len(said)
                        state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
        yield from out()

    return work


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation what is read back from its blocks, in order, one block at a time."""
    ready = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ready.mapInArrow(_digester(parse, unescape), DIGEST)
