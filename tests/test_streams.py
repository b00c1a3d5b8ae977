"""Streams with restarts: the activity sink, the gate, pairing, batches applied once."""

import json
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylake.streaming import activity, stateful

NOW = {"availableNow": True}
T0 = datetime(2024, 1, 1)


def _lines(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    aside = folder / f".{name}"
    aside.write_text("".join(json.dumps(r) + "\n" for r in rows))
    aside.rename(folder / name)


def _at(seconds: float) -> str:
    return (T0 + timedelta(seconds=seconds)).isoformat()


def _commits(checkpoint: Path) -> list[Path]:
    return sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))


# -- activity sink


def _publish(spark, tmp_path):
    events = spark.readStream.schema("event string, data string").json(f"{tmp_path}/in")
    q = activity.publish(events, f"file://{tmp_path}/out", f"{tmp_path}/check", NOW)
    assert q.awaitTermination(120) and q.exception() is None


def _forget_last_commit(checkpoint: Path) -> None:
    last = _commits(checkpoint)[-1]
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()


def test_epochs_are_published_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    seen = lambda: sorted((r["epoch"], r["event"], r["data"]) for r in activity.published(spark, out).collect())
    _lines(tmp_path / "in", "a.json", [{"event": "activity", "data": "one"}, {"event": "activity", "data": "two\n lines"}])
    _publish(spark, tmp_path)
    first = seen()
    assert [r[1:] for r in first] == [("activity", "one"), ("activity", "two\n lines")]
    # stopped after the epoch was published, before the checkpoint knew: the epoch runs again and adds nothing
    _forget_last_commit(tmp_path / "check")
    _publish(spark, tmp_path)
    assert seen() == first and len(list((tmp_path / "out/epochs").glob("*.json"))) == 1
    assert len(list((tmp_path / "out/parts").glob("*.sse"))) == 1  # what the second run staged is gone
    # stopped before it was published: the files of the lost run do not count, the epoch comes with the next
    _lines(tmp_path / "in", "b.json", [{"event": "activity", "data": "three"}])
    _publish(spark, tmp_path)
    (tmp_path / "out/epochs/000000000001.json").unlink()
    _forget_last_commit(tmp_path / "check")
    assert seen() == first
    _publish(spark, tmp_path)
    _publish(spark, tmp_path)
    assert seen() == [*first, (1, "activity", "three")]


def test_activity_without_its_columns_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="event and data"):
        activity.ActivitySink({"path": "file:///x"}).streamWriter(spark.createDataFrame([], "event string").schema, False)


def test_an_aborted_epoch_leaves_nothing(tmp_path):
    from pyspark.sql import Row

    w = activity.EpochWriter(f"file://{tmp_path}")
    staged = w.write(iter([Row(event="activity", data="x")]))
    assert (tmp_path / "parts" / staged.file).read_text() == "event: activity\ndata: x\n\n"
    w.abort([staged, None], 3)
    assert not list((tmp_path / "parts").iterdir()) and not (tmp_path / "epochs").exists()
    empty = w.write(iter([]))
    w.commit([empty], 4)
    assert json.loads((tmp_path / "epochs/000000000004.json").read_text()) == {"epoch": 4, "files": [], "events": 0} and not list((tmp_path / "parts").iterdir())


def test_events_of_the_dashboard(spark):
    totals = spark.createDataFrame([("b", 5, 1, 2.0), ("a", 5, 0, 1.5)], "tool string, invocations long, errors long, tokens double")
    row = activity.tool_event(totals, F.lit(9)).first()
    assert row["event"] == "activity"
    assert json.loads(row["data"]) == {"type": "tool_activity", "total_invocations": 10, "most_active_tool": "a", "recent_errors": 1, "estimated_tokens_saved": 3, "timestamp": 9}
    none = json.loads(activity.tool_event(totals.limit(0), F.lit(9)).first()["data"])
    assert none["total_invocations"] == 0 and none["most_active_tool"] == ""
    assert json.loads(spark.range(1).select(activity.stats_event({"chunks": F.lit(1), "files": F.lit(2)}, F.lit(3))).first()[0]) == {"type": "stats", "chunks": 1, "files": 2, "timestamp": 3}


# -- gate


def _gate(spark, tmp_path, steps):
    """Runs the gate over one file of rows after the other, the query restarted between them; what each run let out."""
    out = []
    for k, rows in enumerate(steps):
        _lines(tmp_path / "in", f"{k}.json", rows)
        s = spark.readStream.schema("file string, at timestamp, seen timestamp").json(f"{tmp_path}/in")
        q = (
            stateful.held_back(s, "file", "at", "seen").writeStream.format("json").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/check").trigger(**NOW).start()
        )
        assert q.awaitTermination(180) and q.exception() is None
        got = spark.read.schema("file string, at timestamp, changes long").json(f"{tmp_path}/out").collect()
        out.append(sorted((r["file"], int((r["at"] - T0).total_seconds()), r["changes"]) for r in got))
    return out


def test_a_fresh_file_comes_out_once_when_it_rests(spark, tmp_path):
    row = lambda f, at, seen: {"file": f, "at": _at(at), "seen": _at(seen)}
    got = _gate(spark, tmp_path, [
        [row("fresh", 100, 100), row("old", -90_000, 100), {"file": None, "at": _at(0), "seen": _at(100)}],
        [row("other", 130, 130), row("busy", 131, 131)],  # fresh is 30 s old: kept
        [row("busy", 150, 161)],  # 61 s after fresh was changed; busy goes on
        [row("tick", 200, 200)],  # busy was changed 50 s ago
        [row("tick", 211, 400), row("fresh", 399, 400)],  # fresh was changed again
        [row("end", 1000, 1000)],
    ])
    came = [sorted(set(b) - set(a)) for a, b in zip([[]] + got, got)]
    assert [r for step in came[:1] for r in step] in ([], [("old", -90_000, 1)])
    every = got[-1]
    assert len(every) == len(set(every)) and [r for r in every if r[0] != "end"] == sorted([("old", -90_000, 1), ("fresh", 100, 1), ("other", 130, 1), ("busy", 150, 2), ("tick", 211, 2), ("fresh", 399, 1)])
    at = {r: k for k, step in enumerate(came) for r in step}
    assert at["fresh", 100, 1] == 2 and at["busy", 150, 2] > 3 and at["old", -90_000, 1] <= 1 and at["fresh", 399, 1] == 5
    assert ("end", 1000, 1) not in every


# -- pairing


def _pair(spark, tmp_path):
    schema = "id string, at timestamp, name string"
    read = lambda d: spark.readStream.schema(schema).json(f"{tmp_path}/{d}")
    out = stateful.paired(read("uses"), read("results"), "id", "1 hour", late="1 minute").select("id", "name", F.col("result_name").alias("result"))
    q = out.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(**NOW).start()
    assert q.awaitTermination(180) and q.exception() is None
    return sorted((r["id"], r["name"], r["result"]) for r in spark.read.schema("id string, name string, result string").json(f"{tmp_path}/out").collect())


def test_calls_meet_their_results_across_restarts(spark, tmp_path):
    row = lambda i, at, name: {"id": i, "at": _at(at), "name": name}
    _lines(tmp_path / "uses", "0.json", [row("a", 0, "read"), row("b", 5, "write"), row("late", 10, "run"), row("none", 20, "wait"), row(None, 20, "x")])
    _lines(tmp_path / "results", "0.json", [row("a", 1, "ok"), row("before", 2, "stray"), row(None, 3, "y")])
    assert _pair(spark, tmp_path) == [("a", "read", "ok")]
    _lines(tmp_path / "results", "1.json", [row("b", 3000, "failed"), row("b", 3001, "again"), row("late", 3700, "too late")])
    _lines(tmp_path / "uses", "1.json", [row("c", 3100, "edit")])
    assert _pair(spark, tmp_path) == [("a", "read", "ok"), ("b", "write", "again"), ("b", "write", "failed")]
    # both watermarks pass the hour: what has no partner comes out, once
    for k in (2, 3):
        _lines(tmp_path / "uses", f"{k}.json", [row(f"z{k}", 20_000 + k, "end")])
        _lines(tmp_path / "results", f"{k}.json", [row(f"y{k}", 20_000 + k, "end")])
        got = _pair(spark, tmp_path)
    want = {("a", "read", "ok"), ("b", "write", "again"), ("b", "write", "failed"), ("late", "run", None), ("none", "wait", None), ("c", "edit", None)}
    assert set(got) == want and len(got) == len(want)


def test_pairing_of_tables_is_a_left_join(spark):
    t = lambda rows: spark.createDataFrame([(i, T0 + timedelta(seconds=s)) for i, s in rows], "id string, at timestamp")
    got = stateful.paired(t([("a", 0), ("a", 50), ("b", 0), (None, 0)]), t([("a", 40), ("a", 60), ("b", 61), (None, 1)]), "id", "60 seconds")
    times = sorted((r["id"] or "", (r["at"] - T0).seconds, r["result_at"] and (r["result_at"] - T0).seconds) for r in got.collect())
    assert times == [("", 0, None), ("a", 0, 40), ("a", 0, 60), ("a", 50, 60), ("b", 0, None)]
    with pytest.raises(ValueError, match="both"):
        stateful.paired(spark.readStream.format("rate").load(), t([]), "value", "1 hour", "timestamp")
