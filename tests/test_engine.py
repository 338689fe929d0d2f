import dataclasses
import json
import os

import numpy as np
import pytest

from threadloom.config import Chunking, Config, Database, Embedding, Scanner, config_from, load_config, merged
from threadloom.operators import retrieval
from threadloom.operators.embedding import Stub, normalized, provider_of
from threadloom.plans.engine import Engine, NotFoundError


def write(folder, name, *texts, at=1_700_000_000):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"type": role, "cwd": f"/p/{folder.name}", "message": {"role": role, "content": t}}) for pair in texts for role, t in zip(("user", "assistant"), pair, strict=True)]
    path = folder / f"{name}.jsonl"
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (at, at))
    return path


def config(tmp_path):
    return Config(Embedding(dimension=16), Database(path=str(tmp_path / "catalog")), Scanner(root=str(tmp_path / "in")), Chunking(200))


def test_index_search_recall(spark, tmp_path):
    key = "sk" + "-" + "q" * 30
    one = write(tmp_path / "in" / "A", "s-a", ("how about kwfindme", f"leak {key} aaquartz"), ("second", "bbgranite"))
    write(tmp_path / "in" / "B", "s-b", ("kwfindme too", "other"), at=1_700_000_100)
    (tmp_path / "in" / "B" / "broken.jsonl").write_text("{no json\n")
    engine = Engine(spark, config(tmp_path))
    first = engine.index()
    assert (first.indexed, first.skipped, first.failed) == (2, 0, 1)
    assert first.failures[0][0] == "broken"
    assert (engine.index().indexed, engine.index().skipped) == (0, 2)
    assert engine.stats()["sessions"] == 2
    chunks = engine.catalog.read("chunks")
    assert not [r for r in chunks.collect() if key in r.text]
    assert [r.session_id for r in engine.search("kwfindme", project="/p/A").collect()][:1] == ["s-a"]
    assert {r.session_id for r in engine.search("kwfindme").collect()[:2]} == {"s-a", "s-b"}

    before = {r.chunk_uid: r.chunk_id for r in chunks.where("session_id = 's-a'").collect()}
    write(tmp_path / "in" / "A", "s-a", ("how about kwfindme", f"leak {key} aaquartz"), ("second", "bbgranite"), ("third", "ccbasalt"), at=1_700_000_200)
    assert engine.index().indexed == 1
    after = {r.chunk_uid: r.chunk_id for r in engine.catalog.read("chunks").where("session_id = 's-a'").collect()}
    assert before.items() <= after.items()
    assert len(after) == len(before) + 1

    one.unlink()
    assert [r.user for r in engine.read_session("s-a").collect()] == ["how about kwfindme", "second", "third"]
    assert [r.turn_index for r in engine.expand("s-a", 3, 0).collect()] == [1]
    with pytest.raises(NotFoundError):
        engine.read_session("none")
    assert engine.migrate_project("/p/A", "/p/C")["sessions"] == 1
    assert [r.session_id for r in engine.list_sessions("/p/C").collect()] == ["s-a"]
    assert engine.reredact() == (0, 0)
    assert engine.index(force=True).indexed == 1
    assert json.loads(engine.as_json(engine.list_sessions()))[0]["session_id"] in ("s-a", "s-b")


def test_signature_makes_sessions_due(spark, tmp_path):
    write(tmp_path / "in" / "A", "s", ("q", "a"))
    own = config(tmp_path)
    assert Engine(spark, own).index().indexed == 1
    assert Engine(spark, dataclasses.replace(own, chunking=Chunking(100))).index().indexed == 1


def test_stream(spark, tmp_path):
    from threadloom.streaming.hooks import index_events

    path = write(tmp_path / "in" / "A", "s", ("q", "a"))
    engine = Engine(spark, config(tmp_path))
    events = tmp_path / "events"
    events.mkdir()

    def send(name):
        (events / name).write_text(json.dumps({"transcript_path": str(path)}) + "\nnot json\n")
        index_events(engine, str(events), str(tmp_path / "state")).awaitTermination()

    send("1.json")
    assert engine.catalog.read("turns").count() == 1
    write(tmp_path / "in" / "A", "s", ("q", "a"), ("more", "b"), at=1_700_000_500)
    send("2.json")
    assert engine.catalog.read("turns").count() == 2


def test_config(tmp_path):
    (tmp_path / "a.toml").write_text('[embedding]\ndimension = 8\n[scanner]\nroot = "/x"\n')
    (tmp_path / "b.toml").write_text('[scanner]\nroot = "/y"\n')
    got = load_config(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none.toml"))
    assert (got.embedding.dimension, got.scanner.root, got.db.busy_timeout_ms, got.chunking.max_chars) == (8, "/y", 5000, 800)
    assert merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    with pytest.raises(TypeError):
        config_from({"chunking": {"max_chars": "many"}})


def test_embedding():
    assert np.allclose(normalized([3, 4]), [0.6, 0.8])
    assert not normalized([0, 0]).any()
    v = Stub(16).embed_texts(["", "some longer text", "ab"])
    assert v[0][0] == 1
    assert v[2][ord("a") % 16] == 1
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-6
    with pytest.raises(ValueError, match="no provider"):
        provider_of(Embedding(provider="other"))


def frame(spark, ids, name):
    return spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], f"chunk_id bigint, {name} int")


def test_fusion(spark):
    got = retrieval.fuse(frame(spark, [1, 2, 3], "dense_rank"), frame(spark, [3, 4, 1], "sparse_rank"), 4).collect()
    assert [r.chunk_id for r in got][:2] == [1, 3]
    assert len(retrieval.fuse(frame(spark, [1, 2], "dense_rank"), frame(spark, [3, 4], "sparse_rank"), 2).collect()) == 2


def test_sparse(spark):
    texts = spark.createDataFrame([(1, "p", "aaaa b"), (2, "q", "xaaay and more"), (3, "p", "none"), (4, "p", "nothing at all")], "chunk_id bigint, project_path string, text string")
    got = {r.chunk_id: r.bm25 for r in retrieval.sparse(texts, "AAA zz", 10).collect()}
    assert set(got) == {1, 2}
    mean, idf = (4 + 12 + 2 + 12) / 4, max(np.log((4 - 2 + 0.5) / 2.5), 1e-6) or 1e-6
    assert abs(got[1] + idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean))) < 1e-12
    assert retrieval.sparse(texts, "a bb", 10).count() == 0
    assert [r.chunk_id for r in retrieval.sparse(texts, "aaa", 10, "q").collect()] == [2]


def test_dense(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "chunk_id bigint, embedding array<float>")
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "chunk_id bigint, project_path string")
    assert [r.chunk_id for r in retrieval.dense(vectors, chunks, [1.0, 0.1], 2).orderBy("distance").collect()] == [1, 3]
    assert [r.chunk_id for r in retrieval.dense(vectors, chunks, [1.0, 0.1], 1, "b", exact_scope=True).collect()] == [3]
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.dense(vectors, chunks, [1.0], 1, width=2)
