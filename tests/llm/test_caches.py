import sys

from threadloom.llm import common, packing, quality


def test_caches_are_bounded_by_bytes(monkeypatch):
    """A cache that is filled past its bound starts anew, and what it gives stays right."""
    for kind in (common.WordCache, packing.WordIds):
        monkeypatch.setattr(kind, "most", 1 << 20)
    words = [f"word{k}" for k in range(30_000)]
    text = " ".join(words).encode()
    ids, features = packing.word_ids("word_bpe_49k.json"), quality.Features()
    ids.of(text)
    features.of(text)
    for cache in (ids, features):
        held = sys.getsizeof(cache) + sum(sys.getsizeof(k) + common._deep(v) for k, v in cache.items())
        assert 0 < len(cache) < 30_000
        assert held < 1.3 * (1 << 20)
    long = b"x" * 100_000
    before = len(ids)
    ids.of(long)
    assert len(ids) == before


def test_one_operators_state_at_a_time():
    first = common.worker_state("a", 1, lambda: ["a"])
    assert common.worker_state("a", 1, lambda: ["new"]) is first
    common.worker_state("b", 1, lambda: ["b"])
    assert common.worker_state("a", 1, lambda: ["new"]) == ["new"]


def test_spread_join_is_a_join(spark):
    rows = [(k % 7 if k % 3 else 5, k) for k in range(3000)] + [(None, 9000), (99, 9001)]
    left = spark.createDataFrame(rows, "key long, x long")
    right = spark.createDataFrame([(k, 10 * k) for k in range(6)] + [(5, 51), (None, 0)], "key long, y long")
    for how in ("inner", "left"):
        show = lambda df: sorted(map(str, df.select("key", "x", "y").collect()))
        assert show(common.spread_join(left, right, "key", how)) == show(left.join(right, "key", how))


def test_spent_tables_go(spark):
    df = common.written(spark.range(5).toDF("a"), "gone")
    path = df._written_at.removeprefix("file:")
    import os

    assert os.path.isdir(path)
    common.spent(df)
    assert not os.path.isdir(path)
