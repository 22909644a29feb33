"""A mailbox of tasks as a stream: requests are claimed, cancelled, answered, and forgotten after some days.

Events are rows (id, op, at, ok, note): op is request, claim, cancel or result, at an event time, ok whether a result succeeded.
One task's state is what the checkpoint keeps of it, so that a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP_DAYS = 7
MOVE = "id string, op string, at timestamp, accepted boolean, state string, note string"
ORDER = {"request": 0, "claim": 1, "cancel": 2, "result": 3}
FINISHED = ("done", "failed", "cancelled")


def step(state: str | None, op: str, ok: bool | None) -> tuple[str | None, bool, str]:
    """(new state, whether the move is accepted, why not). States: pending, running, done, failed, cancelled; None for an unknown task."""
    if op == "request":
        return ("pending", True, "") if state is None else (state, False, "known")
    if state is None:
        return None, False, "missing"
    if state in FINISHED:
        return state, False, "finished"
    if op == "claim":
        return ("running", True, "") if state == "pending" else (state, False, "running")
    if op == "cancel":
        return ("cancelled", True, "") if state == "pending" else (state, False, "running")
    if op == "result":
        return ("done" if ok else "failed"), True, ""
    return state, False, "unknown operation"


def _moves(keep_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last_ms = held.get if held.exists else (None, 0)
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(key[0], "expire", pd.Timestamp(last_ms + keep_ms, unit="ms"), True, "expired", state)], columns=["id", "op", "at", "accepted", "state", "note"])
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(place=rows["op"].map(ORDER)).sort_values(["at", "place"], kind="stable")
        out = []
        for op, at, ok, note in zip(rows["op"], rows["at"], rows["ok"], rows["note"]):
            state, accepted, why = step(state, op, None if pd.isna(ok) else bool(ok))
            if accepted:
                last_ms = max(last_ms, int(at.value // 1_000_000))
            out.append((key[0], op, at, accepted, state, note if accepted else why))
        if state is not None:
            held.update((state, last_ms))
            if state != "pending":  # what nobody has claimed yet waits for ever
                held.setTimeoutTimestamp(max(last_ms + keep_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "op", "at", "accepted", "state", "note"])

    return run


def mailbox(events: DataFrame, keep_days: float = KEEP_DAYS, late: str = "1 hour") -> DataFrame:
    """A stream of moves (id, op, at, accepted, state, note), one for each event, and one ``expire`` for each task that is forgotten.

    A cancel is accepted while nobody has claimed the task. A second request, a claim of a task that isn't pending, and
    whatever comes for an unknown or finished one change nothing and say why. ``keep_days`` after its last move a task that isn't pending
    is dropped, by event time: an id may then be used anew. Events later than the watermark are dropped.
    """
    timed = events.select(F.col("id").cast("string").alias("id"), "op", "at", "ok", F.coalesce("note", F.lit("")).alias("note")).where("id IS NOT NULL AND at IS NOT NULL")
    state = "state string, last_ms long"
    return timed.withWatermark("at", late).groupBy("id").applyInPandasWithState(_moves(int(keep_days * 86_400_000)), MOVE, state, "append", GroupStateTimeout.EventTimeTimeout)


def task_states(moves: DataFrame) -> DataFrame:
    """(id, state, at): where each task stands by its accepted moves; forgotten ones are left out. For stored moves."""
    place = F.create_map(*[F.lit(x) for kv in (ORDER | {"expire": 4}).items() for x in kv])
    last = moves.where("accepted").groupBy("id").agg(F.max_by(F.struct("state", "at"), F.struct("at", place[F.col("op")])).alias("l"))
    return last.select("id", "l.state", "l.at").where("state <> 'expired'")
