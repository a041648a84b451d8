"""Streams against the batch form."""

from __future__ import annotations

import importlib.util
import json

import pytest

from doclake.streaming import jobs


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def event(job, seq, action=None, line=None, progress=None):
    return {"job": job, "seq": seq, "ts": f"2024-01-01T00:00:{seq:02d}Z", "action": action, "line": line, "progress": progress}


@pytest.mark.skipif(importlib.util.find_spec("google.protobuf") is None if importlib.util.find_spec("google") else True, reason="stateful processors need protobuf")
def test_states(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    write(source, "1.json", [event(1, 1, "start", "a", 5.0), event(2, 1, "cancel"), event(1, 2, None, "b", 250.0)])
    q = jobs.states(jobs.read_events(spark, str(source))).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q.start().awaitTermination()
    write(source, "2.json", [event(1, 3, "finish", None, None)])
    q.start().awaitTermination()
    got = [(r.job, r.state, r.progress, r.log_id, r.last_line) for r in out]
    assert sorted(got[:2]) == [(1, "running", 100.0, 2, "b"), (2, "cancelled", 0.0, 0, None)]
    assert got[2] == (1, "completed", 100.0, 2, "b")


def test_lines(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    (source / "a.log").write_text("[INFO] [2/9] suite one -> a b.txt\nnothing\n[WARNING] [3/9] s -> c.pdf\n")
    q = jobs.read_lines(spark, str(source)).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["index"], r.completed, r.suite, r.file, r.level) for r in out] == [(2, 1, "suite one", "a b.txt", "INFO"), (3, 2, "s", "c.pdf", "WARN")]


def test_new_files(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    for n in ("a", "b"):
        (source / n).write_bytes(b"same")
    (source / "c").write_bytes(b"other")
    q = jobs.new_files(spark, str(source)).select("sha256").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) == 2
