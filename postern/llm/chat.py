"""Chat formatting in budgeted, turn-aligned windows.

A window holds the conversation's system turn, up to ``history`` tokens of turns that the window before ended with, and new
turns up to ``budget`` tokens in all. Prefix sums of the turns' token counts choose the spans. Targets are the texts of
assistant turns; repeated turns are masked, so each target counts once. A single turn over the budget has a window to itself.

Turns are tokenised before they are dealt, so a conversation that holds a third of all rows costs many tasks that work. Rows
are then dealt by conversation and sorted by turn; a task streams them, holding one window's turns at a time. A conversation of
any length is thus formatted in bounded memory; only its windows follow one another, as each begins where the last one ended.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import boolean, long, map_texts, string
from postern.llm.tokens import Ids

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256

_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """No ``<|`` is left: each ``<``, n backslashes, ``|`` gets one backslash more."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its escaped text begins in it."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and the span of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


Turn = tuple[str, str, int]  # role, text, tokens


def windows(turns: Iterator[Turn], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[list[Turn], int, int]]:
    """(turns of the window, how many of them are repeated, index of its first new turn)."""
    source = iter(turns)
    buffer: list[Turn] = []
    sums = [0]
    base = 0
    system: list[Turn] = []
    back: list[Turn] = []
    ended = False
    first = True
    while True:
        while not ended and sums[-1] <= budget:
            turn = next(source, None)
            if turn is None:
                ended = True
            else:
                buffer.append(turn)
                sums.append(sums[-1] + turn[2])
        if not buffer:
            return
        if first and buffer[0][0] == "system":
            system = buffer[:1]
        before = [] if first else system
        room = budget - sum(t[2] for t in before)
        while back and sum(t[2] for t in back) + buffer[0][2] > room:  # history gives way to the next turn
            back = back[1:]
        room -= sum(t[2] for t in back)
        n = max(1, bisect_right(sums, room) - 1)
        new = buffer[:n]
        yield [*before, *back, *new], len(before) + len(back), base
        tail = [*back, *new]
        if first and system:
            tail = tail[1:]
        total = [0]
        for t in reversed(tail):
            total.append(total[-1] + t[2])
        keep = min(bisect_right(total, history) - 1, len(tail))
        back = tail[len(tail) - keep :] if keep else []
        buffer = buffer[n:]
        base += n
        sums = [0]
        for t in buffer:
            sums.append(sums[-1] + t[2])
        first = False


WINDOW_FIELDS = [long("conv_id"), long("window"), long("first_turn"), long("n_turns"), long("n_repeated"), long("n_tokens"), boolean("over_budget"), string("formatted"), T.StructField("loss_spans", T.ArrayType(T.LongType()))]


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """One row per window, in order within a conversation and task: the formatted text, and loss_spans, the flat code-point spans under the loss mask.

    Null texts and roles count as empty. Turns are taken by turn (null first), then role and text, so ties and repeated rows
    have one order; each row is a turn of its own. Rows without conv_id are together the conversation without id. Other columns do not pass.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def tokens():
        count = Ids(tokenizer).count
        return lambda roles, texts: [[count(render(r.decode(), t.decode())[0]) for r, t in zip(roles, texts, strict=True)]]

    rows = map_texts(rows, tokens, [long("n_tokens")], ["role", "text"])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType(WINDOW_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[list] = [[] for _ in WINDOW_FIELDS]
        held = 0

        def drain() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)
            for c in out:
                c.clear()
            held = 0
            return batch

        for conv, turns in conversations_of(batches):
            for k, (shown, repeated, base) in enumerate(windows(turns, budget, history)):
                parts, spans, at, tokens = [], [], 0, 0
                for j, (role, text, n) in enumerate(shown):
                    piece, begins = render(role, text)
                    if role == "assistant" and j >= repeated:
                        spans += [at + begins, at + len(piece) - len(END) - 1]
                    parts.append(piece)
                    at += len(piece)
                    tokens += n
                for c, v in zip(out, (conv, k, base, len(shown), repeated, tokens, tokens > budget, "".join(parts), spans), strict=True):
                    c.append(v)
                held += at
                if held > 1 << 22:
                    yield drain()
        if out[0]:
            yield drain()

    return rows.mapInArrow(run, schema)


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations of a sorted stream (conv_id, turn, role, text, n_tokens), each a lazy stream of its turns."""
    from itertools import groupby

    def flat():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)

    for conv, group in groupby(flat(), key=lambda r: r[0]):
        yield conv, (r[1:] for r in group)


DIGEST_FIELDS = [long("conv_id"), long("n_turns"), string("turns_sha256"), long("loss_chars"), string("loss_sha256"), long("formatted_chars"), long("n_windows")]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the windows alone. ``formatted`` comes straight from format_windows(): its tasks hold whole conversations in order."""
    schema = T.StructType(DIGEST_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows: list[tuple] = []
        state: list = []

        def close() -> None:
            if state:
                conv, n, turns, chars, loss, formatted_chars, n_windows = state
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, n_windows))
                state.clear()

        for batch in batches:
            for r in batch.select(["conv_id", "window", "n_repeated", "formatted", "loss_spans"]).to_pylist():
                if r["window"] == 0:
                    close()
                    state[:] = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(r["formatted"])[r["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                spans = r["loss_spans"]
                for lo, hi in zip(spans[::2], spans[1::2], strict=True):
                    text = unescape(r["formatted"][lo:hi])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
                state[6] += 1
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return formatted.mapInArrow(run, schema)
