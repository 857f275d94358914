"""Operator 6: chat formatting in budgeted windows.

A conversation's turns are ordered by turn. Its first turn, if that is a system turn, is
retained at the head of every window. The others are cut into windows by prefix sums of
their tokens: a window holds as many whole new turns as the budget leaves beside the
system turn and a history, the last turns before them of at most history tokens. If no new
turn fits beside the history, the history is left out; a turn that is too long even then
has a window of its own, over_budget. Each turn but the system turn is new in exactly one
window.

Targets are the assistant's new turns. mask has a character for each turn of the window:
1 for a target, 0 for others, so the assistant's repeated turns aren't trained twice.

Tokens are runs of letters and digits, and other single characters that aren't white space;
overhead tokens are added for each turn.

Result: conv_id, window (from 0), history_turn, first_turn, last_turn (turn numbers;
history_turn is first_turn without history), n_tokens, target_tokens, mask, over_budget, text.
Numbers of conversations and turns are integers; other types raise a TypeError. Turns with a
null conv_id, turn or role are left out, a null text is empty. Repeated rows
count once; turns of the same number follow each other by role and text. A conversation of
a system turn alone has no window. An empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SCHEMA = "conv_id long, window int, history_turn long, first_turn long, last_turn long, n_tokens long, target_tokens long, mask string, over_budget boolean, text string"


def spans(prefix: np.ndarray, room: int, history: int) -> list[tuple[int, int, int, bool]]:
    """(history begin, begin, end, over) of each window; prefix[i] = tokens of the first i turns."""
    n, begin, out = len(prefix) - 1, 0, []
    while begin < n:
        h = int(np.searchsorted(prefix, prefix[begin] - history, side="left"))
        end = int(np.searchsorted(prefix, prefix[h] + room, side="right")) - 1
        if end <= begin:
            h = begin
            end = int(np.searchsorted(prefix, prefix[h] + room, side="right")) - 1
        over = end <= begin
        end = max(end, begin + 1)
        out.append((h, begin, end, over))
        begin = end
    return out


def _render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


def _windows(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turns = turns.as_py()
                system = turns[:1] if turns[0]["role"] == "system" else []
                rest = turns[len(system) :]
                prefix = np.concatenate([[0], np.cumsum([t["tokens"] for t in rest])]).astype(np.int64)
                head = sum(t["tokens"] for t in system)
                for k, (h, begin, end, over) in enumerate(spans(prefix, budget - head, history)):
                    targets = ["1" if i >= begin and rest[i]["role"] == "assistant" else "0" for i in range(h, end)]
                    rows.append((
                        conv, k, rest[h]["turn"], rest[begin]["turn"], rest[end - 1]["turn"], int(prefix[end] - prefix[h]) + head,
                        sum(rest[h + i]["tokens"] for i, x in enumerate(targets) if x == "1"), "0" * len(system) + "".join(targets), over, "".join(_render(t["role"], t["text"]) for t in [*system, *rest[h:end]]),
                    ))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def chat_windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 768, history: int = 192, overhead: int = 3) -> DataFrame:
    """Training windows of conversations."""
    turns = conversations.select(S.id_of(conversations, conv_col).alias("conv_id"), S.id_of(conversations, turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.where("conv_id is not null and turn is not null and role is not null")
    counted = turns.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + overhead).cast("long"))
    # Every turn of a conversation meets in one shuffle; there repeated rows go and turns sort.
    whole = counted.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text", "tokens"))).alias("turns"))
    return whole.mapInArrow(_windows(budget, history), SCHEMA)
