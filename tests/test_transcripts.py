import json

from pyspark.sql import functions as F

from threadloom.operators.chunks import split_column, split_text
from threadloom.operators.turns import failed_sessions, turns_of, window_around
from threadloom.sources.transcripts import parse_lines, scan, transcript_lines


def turns(spark, *events):
    lines = [(f"s{0}", k + 1, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(events)]
    parsed = parse_lines(spark.createDataFrame(lines, "session_id string, line bigint, text string"))
    return parsed, [r.asDict() for r in turns_of(parsed).orderBy("turn_index").collect()]


def said(role, content, **more):
    return {"type": role, "message": {"role": role, "content": content}} | more


def test_events_become_turns(spark):
    bash = {"type": "tool_use", "name": "Bash", "input": {"command": "echo  hello"}}
    _, got = turns(spark, "", said("user", "<system-reminder>x</system-reminder>Hello   world", timestamp="t1"), said("assistant", [{"type": "text", "text": "Hi"}, bash]))
    assert [(t["user"], t["assistant"], t["tool_summary"], t["line_start"], t["line_end"], t["ts"]) for t in got] == [("Hello world", "Hi", ["Bash: echo hello"], 2, 3, "t1")]


def test_hooks_and_skipped_types(spark):
    _, got = turns(spark, said("user", "a"), {"type": "hook_event", "message": {"role": "user", "content": "b"}}, said("user", "c", hook="x"), said("user", "<HOOK>"), said("system", "d"), said("user", "e", hook_event_name=None, hook="x"))
    assert [t["user"] for t in got] == ["a", "e"]


def test_tool_results_join_the_turn_before(spark):
    read = {"type": "tool_use", "name": "Read", "input": {"file_path": "/srv/notes.md"}}
    result = {"type": "tool_result", "content": "opening words\nmore"}
    _, got = turns(spark, said("user", [result]), said("assistant", "lost"), said("user", "q"), said("assistant", [read]), said("user", [result, {"type": "text", "text": "next"}]), said("assistant", "one"), said("assistant", "two"))
    assert [(t["user"], t["assistant"], t["tool_summary"], t["line_start"], t["line_end"]) for t in got] == [("q", "", ["Read: /srv/notes.md", "Tool result: opening words"], 3, 5), ("next", "one\n\ntwo", [], 5, 7)]


def test_tool_summaries(spark):
    def use(name, **given):
        return {"type": "tool_use", "name": name, "input": given}

    uses = [use("Edit", file_path=None, path="p"), use("Grep", pattern="x", path="y"), use("TodoWrite", todos=[1, 2]), use("Web", b=1, a=True, content="no", c={"k": [1]}, d="z"), {"type": "tool_use"}, use("Web", v="w" * 90)]
    _, got = turns(spark, said("user", "q"), said("assistant", uses), said("user", [{"type": "tool_result", "is_error": True, "content": [{"text": "bad"}, {"text": "thing"}]}]))
    assert got[0]["tool_summary"] == ["Edit", "Grep: x, y", "TodoWrite: 2 todos", 'Web: a=true, b=1, c={"k":[1]}', "tool", "Web: v=" + "w" * 79 + "...", "Tool result error: bad thing"]


def test_timestamps_and_failures(spark):
    _, got = turns(spark, said("user", "a", timestamp=None, created_at="x"), said("user", "b", created_at=5))
    assert [t["ts"] for t in got] == [None, "5"]
    parsed, _ = turns(spark, said("user", "a"), '{"a": 1} trailing', "NaN")
    assert [tuple(r) for r in failed_sessions(parsed).collect()] == [("s0", 2)]


def test_split_text():
    long = "a " * 200
    parts = split_text(long, 120)
    assert len(parts) > 1
    assert max(map(len, parts)) <= 120
    assert "".join(parts).replace(" ", "") == "a" * 200
    assert split_text("p one\n\np two\n\n" + "x" * 30, 14) == ["p one\n\np two", "x" * 14, "x" * 14, "xx"]
    assert split_text("short", 10) == ["short"]


def test_split_column_and_windows(spark):
    df = spark.createDataFrame([("a " * 30,), ("short",), (None,)], "x string").select(split_column(F.col("x"), 20).alias("p"))
    assert [None if r.p is None else [len(x) for x in r.p] for r in df.collect()] == [[19, 19, 19], [5], None] or [r.p for r in df.collect()][1] == ["short"]
    rows = spark.createDataFrame([("s", k, 10 * k) for k in range(6)], "session_id string, turn_index bigint, line_start bigint")
    assert sorted(r.turn_index for r in window_around(rows, 15, 1).collect()) == [1, 2, 3]
    assert sorted(r.turn_index for r in window_around(rows, 999, 2).collect()) == [3, 4, 5]


def test_scan(spark, tmp_path):
    folder = tmp_path / "-srv-work"
    folder.mkdir()
    (folder / "talk7.jsonl").write_text(json.dumps(said("user", "q")) + "\n")
    (folder / "ignore.txt").write_text("x")
    (folder / "bad.jsonl").write_bytes(b"\xff\xfe\n")
    rows = {r.session_id: r for r in scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"talk7", "bad"}
    assert rows["talk7"].project_path == "/srv/work"
    assert scan(spark, str(tmp_path / "missing")).count() == 0
    events = parse_lines(transcript_lines(scan(spark, str(tmp_path))))
    assert [r.session_id for r in failed_sessions(events).collect()] == ["bad"]
