import dataclasses
import io
import json

import pytest

from threadloom.__main__ import hook_path, run
from threadloom.config import Config, Database, Embedding, Scanner, config_of
from threadloom.plans.catalog import KEPT, ConflictError
from threadloom.plans.engine import ArgumentError, Engine


@pytest.fixture
def home(tmp_path):
    folder = tmp_path / "talks" / "-srv-work"
    folder.mkdir(parents=True)
    lines = [{"type": "user", "message": {"role": "user", "content": "How is the cache emptied? token=abc"}}, {"type": "assistant", "message": {"role": "assistant", "content": "Remove the folder."}}]
    (folder / "talk1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    config = Config(embedding=Embedding(dimension=16), db=Database(path=str(tmp_path / "db")), scanner=Scanner(root=str(tmp_path / "talks")))
    return folder, config


def said(spark, config, *argv, stdin=""):
    out = io.StringIO()
    status = run(argv, spark, io.StringIO(stdin), out, config)
    return status, json.loads(out.getvalue()) if out.getvalue() else None


def test_commands(spark, home):
    folder, config = home
    assert said(spark, config) == (0, dataclasses.asdict(config))
    assert [r["session_id"] for r in said(spark, config, "scan")[1]] == ["talk1"]
    assert said(spark, config, "index")[1]["indexed"] == 1
    assert said(spark, config, "index")[1] == {"indexed": 0, "skipped": 1, "failed": 0, "failures": []}
    assert said(spark, config, "status")[1]["sessions"] == 1
    (hit,) = said(spark, config, "search", "cache emptied")[1]
    assert "token=<redacted>" in hit["text"]
    assert len(said(spark, config, "parse", str(folder / "talk1.jsonl"))[1]["turns"]) == 1
    assert said(spark, config, "migrate", "--from", "/srv/work", "--to", "/srv/new")[1] == {"sessions": 1, "chunks": 1}
    assert said(spark, config, "sessions", "--project", "/srv/new")[1][0]["session_id"] == "talk1"
    assert said(spark, config, "redact-db")[1] == {"turns": 0, "chunks": 0}
    assert said(spark, config, "read", "missing")[0] == said(spark, config, "search", "  ")[0] == said(spark, config, "search", "x", "--limit", "-1")[0] == 2
    (folder / "talk2.jsonl").write_text((folder / "talk1.jsonl").read_text() + "\n")
    payload = json.dumps({"transcript_path": str(folder / "talk2.jsonl")})
    assert said(spark, config, "hook-stop", stdin=payload)[1]["indexed"] == 1
    assert said(spark, config, "hook-stop", stdin="no JSON") == (0, None)


def test_hook_payloads():
    assert hook_path(io.StringIO('{"transcript_path": "/a"}')) == "/a"
    assert [hook_path(io.StringIO(x)) for x in ("", "[1]", "{}", '{"transcript_path": 5}')] == [None] * 4


def test_settings_of_a_project(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / ".threadloom.toml").write_text("[chunking]\nmax_chars = 99\n")
    assert config_of(str(tmp_path)).chunking.max_chars == 99
    monkeypatch.chdir(tmp_path)
    assert config_of().chunking.max_chars == 99


def test_of_two_changes_one_is_refused(spark, home):
    _, config = home
    engine = Engine(spark, config)
    engine.index()
    catalog = engine.catalog
    base = catalog.manifest()
    rows = catalog.read("sessions", base)
    touched = catalog.touched(rows)
    catalog.commit({"sessions": rows}, touched, base=base)
    with pytest.raises(ConflictError):
        catalog.commit({"sessions": rows.limit(0)}, touched, base=base)
    assert catalog.read("sessions").count() == 1
    for _ in range(KEPT + 2):
        catalog.commit({"sessions": catalog.read("sessions")}, touched)
    assert len(catalog._numbers()) == KEPT
    assert catalog.read("sessions").count() == catalog.read("turns").count() == 1
    with pytest.raises(ArgumentError):
        engine.search(" ")
