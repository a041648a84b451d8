"""Operator 8: chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, a user's first and an assistant's last.
Dynamic programming walks the given turns in order through the automaton of what may come next and chooses, at least total cost:

* keep a turn (0), or relabel it as another role (``RELABEL``; ``UNKNOWN`` where its role is none of the three, which it cannot keep);
* merge it into the turn before (``MERGE`` if both have one role as given; else the relabelling is paid too);
* insert an empty turn (``INSERT``).

Of equal costs the choice is: keep or relabel before merge before insert, and of roles user before assistant before system,
decided from the first turn on. Turns are ordered by turn number, null first, then role and text; repeated rows are turns like others. Null
texts are empty and null roles unknown. Roles compare in lower case without surrounding blanks.

The repaired turns are rendered ``<|role|>\\ntext<|end|>\\n``, with ``<|`` in texts written ``<\\|``. Result: ``conv_id, text, cost,
n_turns, n_rendered, ops`` (one letter a step: k keep, r relabel, m merge, i insert). Null conversation ids are one conversation; an
empty table gives an empty result; other columns are not read. A conversation's turns are gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

ROLES = ("user", "assistant", "system")
RELABEL, UNKNOWN, MERGE, INSERT = 4, 2, 1, 2
#: What may follow each state; '' is the start.
NEXT = {"": ("user", "system"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
END = ("assistant",)


def _cost(given: str, role: str) -> int:
    return 0 if given == role else UNKNOWN if given not in ROLES else RELABEL


def repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    """Least cost and its steps (letter, role); insert steps stand for no given turn. No turns need no repair."""
    return _repair(roles) if len(roles) <= 64 else _repair.__wrapped__(roles)


@lru_cache(100_000)
def _repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    if not roles:
        return 0, ()
    states = ("", *ROLES)
    n = len(roles)

    def hops(best: dict[str, tuple[float, tuple]]) -> None:
        """Let every state be reached by inserting turns after its cost without them is known."""
        for _ in states:
            for s in states:
                for r in NEXT[s]:
                    if best[r][0] + INSERT < best[s][0]:
                        best[s] = (best[r][0] + INSERT, ("i", r))

    after = {s: ((0.0, ()) if s in END else (float("inf"), ())) for s in states}
    hops(after)
    table = [after]
    for k in range(n - 1, -1, -1):
        now: dict[str, tuple[float, tuple]] = {}
        for s in states:
            options = []
            for order, r in enumerate(ROLES):
                if r in NEXT[s]:
                    options.append((_cost(roles[k], r) + after[r][0], 0, order, ("k" if roles[k] == r else "r", r)))
            if s:
                options.append((MERGE + _cost(roles[k], s) + after[s][0], 1, 0, ("m", s)))
            options = [x for x in options if x[0] < float("inf")]
            best = min(options) if options else (float("inf"), 0, 0, ())
            now[s] = (best[0], best[3])
        hops(now)
        after = now
        table.append(now)
    steps, s, k = [], "", 0
    while True:
        step = table[n - k][s][1]
        if not step:
            break
        steps.append(step)
        s = step[1]
        k += step[0] != "i"
    return int(table[n][""][0]), tuple(steps)


def render(turns: list[tuple[str, str]]) -> tuple[str, int, int, str]:
    """Text, cost, turns rendered and letters for (role, text) turns."""
    cost, steps = repair(tuple(r for r, _ in turns))
    out: list[tuple[str, list[str]]] = []
    given = iter(turns)
    for letter, role in steps:
        text = "" if letter == "i" else next(given)[1]
        if letter == "m":
            out[-1][1].append(text)
        else:
            out.append((role, [text]))
    body = "".join(f"<|{r}|>\n" + "\n".join(t.replace("<|", "<\\|") for t in ts) + "<|end|>\n" for r, ts in out)
    return body, cost, len(out), "".join(x for x, _ in steps)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One rendered row for each conversation; see the module's docstring."""
    role = F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("")).alias("role")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in col(b, "turns").to_pylist()]
            n = pc.list_value_length(col(b, "turns")).cast(pa.int64())
            yield pa.record_batch([col(b, "conv_id"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), n, pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.string())], ["conv_id", "text", "cost", "n_turns", "n_rendered", "ops"])

    return chats.mapInArrow(run, "conv_id long, text string, cost long, n_turns long, n_rendered long, ops string")
