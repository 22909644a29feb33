"""Mailboxes and reviews as streams, with restarts and replays."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.sources.stored import StoredTables
from marginalia.streaming import mailbox as mb
from marginalia.streaming import review as rv

EVENT = "id string, op string, at timestamp, ok boolean, note string"


@pytest.mark.parametrize(("state", "op", "ok", "want"), [
    (None, "request", None, ("pending", True, "")), ("pending", "request", None, ("pending", False, "known")), (None, "cancel", None, (None, False, "missing")), ("pending", "cancel", None, ("cancelled", True, "")),
    ("running", "cancel", None, ("running", False, "running")), ("done", "cancel", None, ("done", False, "finished")), ("pending", "claim", None, ("running", True, "")), ("running", "claim", None, ("running", False, "running")),
    ("running", "result", True, ("done", True, "")), ("pending", "result", False, ("failed", True, "")), ("failed", "result", True, ("failed", False, "finished")), ("running", "dance", None, ("running", False, "unknown operation")),
])
def test_step(state, op, ok, want):
    assert mb.step(state, op, ok) == want


def drop(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("id", "op", "at", "ok", "note"), r))) for r in rows))


def test_mailbox_over_three_batches_and_a_restart(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    day = "2024-01-{:02d}T{:02d}:00:00"

    def run():
        stream = spark.readStream.schema(EVENT).json(str(inbox))
        mb.mailbox(stream).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r.id, r.op, r.accepted, r.state, r.note) for r in spark.read.parquet(out).collect()}

    drop(inbox, "b1", [("t1", "request", day.format(1, 1), None, "js"), ("t2", "request", day.format(1, 1), None, "cmd"), ("t1", "claim", day.format(1, 2), None, None), ("t3", "cancel", day.format(1, 2), None, None), (None, "request", day.format(1, 1), None, None)])
    first = run()
    assert first == {("t1", "request", True, "pending", "js"), ("t2", "request", True, "pending", "cmd"), ("t1", "claim", True, "running", ""), ("t3", "cancel", False, None, "missing")}
    # a restart from the checkpoint: the states are known still
    drop(inbox, "b2", [("t1", "cancel", day.format(1, 3), None, None), ("t2", "cancel", day.format(1, 3), None, None), ("t1", "result", day.format(1, 4), True, "fine"), ("t1", "result", day.format(1, 5), False, None), ("t4", "request", day.format(1, 5), None, "")])
    second = run() - first
    assert second == {("t1", "cancel", False, "running", "running"), ("t2", "cancel", True, "cancelled", ""), ("t1", "result", True, "done", "fine"), ("t1", "result", False, "done", "finished"), ("t4", "request", True, "pending", "")}
    # over seven days later the finished ones are forgotten, the pending one isn't, and an id may be used anew
    drop(inbox, "b3", [("t9", "request", day.format(20, 1), None, "")])
    run()
    drop(inbox, "b4", [("t1", "request", day.format(20, 2), None, "again"), ("t4", "claim", day.format(20, 2), None, "")])
    last = run()
    assert {("t1", "expire", True, "expired", "done"), ("t2", "expire", True, "expired", "cancelled"), ("t1", "request", True, "pending", "again"), ("t4", "claim", True, "running", "")} <= last
    assert not any(x[0] == "t4" and x[1] == "expire" for x in last)
    states = {r.id: r.state for r in mb.task_states(spark.read.parquet(out)).collect()}
    assert states == {"t1": "pending", "t4": "running", "t9": "pending"}


PENDING = "session string, id int, status string, batch long, asked string"


def tables(spark, root):
    t = StoredTables(spark, str(root), key="session", buckets=4)
    t.create("pending", spark.createDataFrame([("s", 1, "pending", None, "a"), ("s", 2, "pending", None, "b"), ("u", 1, "rejected", -1, "c"), ("v", 7, "pending", None, "d")], PENDING))
    t.create("refused", spark.createDataFrame([("zz", 0, "x", -5, "seed")], "session string, id int, status string, batch long, why string"))
    return t


MARK = "session string, id int, status string, at string"


def state(t):
    return sorted(((r.session, r.id, r.status, r.batch) for r in t.read("pending").collect()), key=str), sorted((r.session, r.id, r.status, r.batch, r.why) for r in t.read("refused").where("batch >= 0").collect())


def test_marks_are_merged_once(spark, tmp_path):
    t = tables(spark, tmp_path / "kb")
    marks = spark.createDataFrame([("s", 1, "approved", "1"), ("s", 1, "rejected", "2"), ("u", 1, "approved", "1"), ("w", 9, "approved", "1"), ("s", 2, "maybe", "1")], MARK)
    rv.merge_marks(t, marks, 0)
    once = state(t)
    assert once[0] == [("s", 1, "approved", 0), ("s", 2, "pending", None), ("u", 1, "rejected", -1), ("v", 7, "pending", None)]
    assert once[1] == [("s", 1, "rejected", 0, "marked twice"), ("s", 2, "maybe", 0, "no decision"), ("u", 1, "approved", 0, "already rejected"), ("w", 9, "approved", 0, "unknown")]
    rv.merge_marks(t, marks, 0)
    assert state(t) == once
    rv.merge_marks(t, spark.createDataFrame([("s", 1, "rejected", "3"), ("s", 2, "rejected", "3")], MARK), 1)
    assert state(t)[0][:2] == [("s", 1, "approved", 0), ("s", 2, "rejected", 1)] and ("s", 1, "rejected", 1, "already approved") in state(t)[1]


def test_marks_as_a_stream_with_a_lost_driver(spark, tmp_path, monkeypatch):
    t = tables(spark, tmp_path / "kb")
    inbox = tmp_path / "in"
    inbox.mkdir()
    put = lambda name, rows: (inbox / name).write_text("\n".join(json.dumps(dict(zip(("session", "id", "status", "at"), r))) for r in rows))
    run = lambda: rv.follow_marks(t, spark.readStream.schema(MARK).json(str(inbox)), str(tmp_path / "check")).awaitTermination()
    put("a.json", [("s", 1, "approved", "1")])
    run()
    put("b.json", [("v", 7, "rejected", "1"), ("s", 1, "rejected", "1")])

    def lost(self, name):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(StoredTables, "_carry_out", lost)
        with pytest.raises(Exception, match="lost"):
            run()
    run()  # the batch is committed already, and is run again
    rows, refused = state(t)
    assert rows == [("s", 1, "approved", 0), ("s", 2, "pending", None), ("u", 1, "rejected", -1), ("v", 7, "rejected", 1)]
    assert refused == [("s", 1, "rejected", 1, "already approved")]
    assert t.read("pending").where(F.col("id") == 1).count() == 2
