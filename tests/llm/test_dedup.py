import hashlib
import math
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import GroupedData

from threadloom.llm import embedding_dedup, graph, jaccard, shingles, suffix_dedup, topk
from threadloom.llm.shingles import Shingler

DOCS = "doc_id long, text string, lang string, node long, text_hash long, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS)


def least(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if p[0] is not None and p[0] != p[1]]
    assert got == least(real, {x for p in real for x in p})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("few", "most"), [(100_000, 2), (40, 99), (0, 99)])
def test_components_of_few_edges(spark, monkeypatch, few, most):
    """Few edges are joined by one task: a long chain takes two tables that the driver has written, not one for each
    step (over ten before). With a smaller bound, rounds come first or do all, and components are the same."""
    rng, made = random.Random(3), []
    monkeypatch.setattr(graph, "FEW", few, raising=False)
    monkeypatch.setattr(graph, "written", lambda df, name, put=graph.written: (made.append(name), put(df, name))[1])
    chain = rng.sample(range(1000, 9000), 200)
    pairs = [*zip(chain, chain[1:], strict=False)] + [(rng.randint(-90, 300), rng.randint(-90, 300)) for _ in range(150)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (7, 7)], "a long, b long")).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert got == least(real, {x for p in real for x in p})
    assert (2 if few > 9000 else 3) <= len(made) <= most


def near_texts(rng, count):
    """Families of texts with random edits, about the threshold; sets small and large."""
    words = [f"w{k}" for k in range(4000)]
    out = []
    for _ in range(count):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 300, 1500]))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, len(own) // 60)])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    passage = " ".join(rng.choice(words) for _ in range(60))
    return out + [" ".join(rng.choice(words) for _ in range(40)) + " " + passage for _ in range(40)]


def linked_brute(sets):
    pairs, ids = [], [i for i in sets if sets[i]]
    holders = defaultdict(list)
    for i in ids:
        for h in sets[i]:
            holders[h].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] += 1
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]


@pytest.mark.parametrize(("points", "shingles_"), [(4096, 100_000), (6, 300)])
def test_jaccard(spark, monkeypatch, points, shingles_):
    """With small tiles, buckets and components of many blocks give the same."""
    monkeypatch.setattr(jaccard, "TILE_POINTS", points)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", shingles_)
    rng = random.Random(2)
    texts = near_texts(rng, 120)
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one  TWO"), (9005, "one two three"), (9006, "a\u00a0b c"), (9007, texts[0].upper()), (9008, "rep " * 400), (9009, "rep " * 9)]
    rng.shuffle(rows)
    rows.append(rows[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    shingler, sets = Shingler(5), {}
    for i, t in rows:
        sets[i] = set(shingler.set_of((t or "").encode()).tolist())
    roots = least(linked_brute(sets), sets)
    assert got == {i: (len(sets[i]), roots[i]) for i in sets}
    assert got[9003][1] == got[9004][1] == 9003
    assert got[9001] == (0, 9001)
    assert got[9008][1] == got[9009][1] == 9008
    assert jaccard.join(frame(spark, rows)).count() == len(rows)
    assert jaccard.join(frame(spark, [])).count() == 0


def test_shingles_by_brute_force(monkeypatch):
    """Texts hashed together, alone, or in parts give one set for one sequence of words."""
    rng = random.Random(4)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    words = ["a", "B", "\u00e9t\u00e9", "x" * 50, "y" * 70, "z" * 200, "\u4e2d"]
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "\t \n", "\x0b"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    names = {}
    for text, h in zip(texts, Shingler(5).sets([t.encode() for t in texts]), strict=True):
        own = "".join(c.lower() if c.isascii() else c for c in text).split()
        brute = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
        assert len(brute) == len(h)
        for x in h.tolist():
            names.setdefault(x, []).append(brute)
        assert (Shingler(5).set_of(text.encode()) == h).all()
    for sets in names.values():  # texts that share a hash share a shingle
        assert set.intersection(*sets)


@pytest.mark.parametrize("seed", range(4))
def test_tree_join_is_exact(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = b[rng.random(len(b)) < rng.choice([1, 0.97, 0.9, 0.85])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    threshold = jaccard.Threshold(4, 5)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert least(jaccard.linked_forest(sets, threshold), range(len(sets))) == least(links, range(len(sets)))
    # linked sets share a key at some level, whatever is common
    common = np.sort(np.concatenate(base[:3]))
    keys = []
    for s in sets:
        rare = ~np.isin(s, common)
        keys.append({k for level in threshold.levels(len(s)) for k in jaccard.keys_of(s, level, rare, threshold).tolist()})
    assert all(keys[i] & keys[j] for i, j in links)


def brute_cut(rows):
    seen, out = defaultdict(lambda: None), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - 49):
            first = seen[b[k : k + 50]]
            if first is not None and first < i:
                covered[k : k + 50] = b"\1" * 50
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] is None:
                seen[b[k : k + 50]] = i
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        runs = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        out.setdefault(i, []).append((len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé 中") for _ in range(n))
    passages = [text(rng.choice([40, 48, 60, 300])) for _ in range(6)]
    rows = [(k, text(rng.randint(0, 60)) + "".join(rng.choice(passages) + text(rng.choice([0, 5, 80])) for _ in range(rng.randint(0, 4)))) for k in range(160)]
    rows += [(200 + k, rows[k][1]) for k in range(8)] + [(300, None), (301, ""), (302, "x" * 700), (303, "x" * 90), (304, "x" * 49), (0, rows[3][1]), (7, rows[7][1])]
    hot = text(200)
    rows += [(400 + k, text(70) + hot + text(70)) for k in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = cut_rows(seed)
    out = suffix_dedup.deduplicate(frame(spark, rows)).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    wanted = brute_cut(rows)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in wanted.items()}
    assert len(out) == len(rows)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.deduplicate(frame(spark, [])).count() == 0
    (r,) = suffix_dedup.deduplicate(frame(spark, [(None, "y" * 200)])).collect()
    assert (r.n_bytes, r.n_removed) == (200, 0)


@pytest.mark.parametrize("seed", range(3))
def test_run_length_index(seed):
    """Matching statistics, and documents, of strings of the index and of others, against all substrings."""
    rng = random.Random(seed)
    make = lambda: bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 40))) + rng.choice([b"", bytes(range(60)), b"ab" * 30])
    texts = sorted({make() for _ in range(60)})
    docs = np.array([rng.randint(0, 20) for _ in texts])
    index = suffix_dedup.RunLengthIndex(texts, docs)
    windows = defaultdict(lambda: 99)
    for t, d in zip(texts, docs.tolist(), strict=True):
        for k in range(len(t) - 49):
            windows[t[k : k + 50]] = min(d, windows[t[k : k + 50]])
    asked = texts + [make() + rng.choice([b"q", b""]) + make() for _ in range(60)]
    seen = 0
    for who, at, length, _ in index.stream(asked):
        for n, k, size in zip(who.tolist(), at.tolist(), length.tolist(), strict=True):
            longest = max(m for m in range(min(50, len(asked[n]) - k) + 1) if any(asked[n][k : k + m] in t for t in texts))
            assert size == longest
            seen += 1
    assert seen == sum(map(len, asked))
    got = {(n, k): d for n, k, d in zip(*(x.tolist() for x in index.least_of(asked)), strict=True)}
    assert got == {(n, k): windows[t[k : k + 50]] for n, t in enumerate(asked) for k in range(len(t) - 49) if t[k : k + 50] in windows}
    assert len(index.starts) == len(index.first_at) == len(index.last_at) < sum(len(t) + 1 for t in texts)


@pytest.mark.parametrize("letters", [1, 2, 3, 20, 70, 255, 256])
def test_index_of_any_alphabet(letters, monkeypatch):
    """Suffixes are sorted in three passes, each over all of them, for strings as long as spans (six before; four
    where a key holds few letters), and strings of any length and alphabet get the documents that brute force gives."""
    rng = random.Random(letters)
    alphabet = bytes(rng.sample(range(256), letters))
    base = bytes(rng.choice(alphabet) for _ in range(400))
    cut = lambda n: base[(x := rng.randint(0, 400 - n)) : x + n]
    passes, sort = [], np.argsort

    def counted(x, *a, **b):
        passes.append(len(x))
        return sort(x, *a, **b)

    for sizes in ([79] * 40, [0, 1, 49, 50, 51, 300, 400] * 6, [5, 0, 3]):
        texts = sorted({cut(n) for n in sizes})
        docs = np.array([rng.randint(0, 20) for _ in texts])
        monkeypatch.setattr(suffix_dedup.np, "argsort", counted)
        passes.clear()
        index = suffix_dedup.RunLengthIndex(texts, docs)
        monkeypatch.undo()
        if sizes[0] == 79:
            n = sum(len(t) + 1 for t in texts)
            assert passes == [n] * len(passes)
            assert len(passes) <= (3 if letters <= 127 else 4)
        windows = defaultdict(lambda: 99)
        for t, d in zip(texts, docs.tolist(), strict=True):
            for k in range(len(t) - 49):
                windows[t[k : k + 50]] = min(d, windows[t[k : k + 50]])
        got = {(n, k): d for n, k, d in zip(*(x.tolist() for x in index.least_of(texts)), strict=True)}
        assert got == {(n, k): windows[t[k : k + 50]] for n, t in enumerate(texts) for k in range(len(t) - 49)}


def test_index_memory_is_bounded(monkeypatch):
    """An index takes at most 150 bytes for each byte of its strings while it is built (198 before), and windows
    that many documents leave in one cell go into several indexes, equal ones into the same."""
    rng = random.Random(4)
    texts = sorted({bytes(rng.choices(b"abcdefghijklmnop ", k=79)) for _ in range(2000)})
    tracemalloc.start()
    suffix_dedup.RunLengthIndex(texts, np.zeros(len(texts), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 150 * sum(len(t) + 1 for t in texts)
    monkeypatch.setattr(suffix_dedup, "_WINDOW_LOT", 5000)
    windows = [texts[rng.randrange(2000)][:50] for _ in range(4000)]
    flat, start = np.frombuffer(b"".join(windows), np.uint8), 50 * np.arange(4000)
    own = np.arange(0, 4000, 2)
    parts = list(suffix_dedup.lots(own, np.full(4000, 50, np.uint8), start, flat))
    assert sorted(np.concatenate(parts).tolist()) == own.tolist()
    assert len({(windows[i], k) for k, part in enumerate(parts) for i in part}) == len({windows[i] for i in own})
    assert max(map(len, parts)) * 50 < 2 * 5000
    sizes = np.full(4000, 50, np.uint8)
    sizes[0] = 51  # strings of several windows stay together
    assert [x.tolist() for x in suffix_dedup.lots(own, sizes, start, flat)] == [own.tolist()]


def test_marks_come_from_the_index(spark, monkeypatch):
    """Where the index finds nothing, nothing is removed but whole copies, hot passages included."""
    monkeypatch.setattr(suffix_dedup, "marked_by_index", lambda strings, docs: (docs[:0],) * 4)  # goes to the workers by value
    rows = list({t: (i, t) for i, t in sorted(cut_rows(1), key=lambda r: -r[0])}.values())
    assert {r.n_removed for r in suffix_dedup.deduplicate(frame(spark, rows)).collect()} == {0}


def test_hot_passages_are_dealt_out(spark, monkeypatch):
    """Small batches, many crowded anchors: the result is that of brute force all the same."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    monkeypatch.setattr(suffix_dedup, "MANY", 20)
    rows = cut_rows(5)
    got = defaultdict(list)
    for r in suffix_dedup.deduplicate(frame(spark, rows)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in brute_cut(rows).items()}


def test_suffix_rows_are_packed(spark, monkeypatch):
    """Documents that share passages with many others: a row for each pair of bucket and home, and of home and
    group, at most, not one for each document and part."""
    rng = random.Random(3)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2000)]
    rows = [(k, "".join(rng.choice(passage) for _ in range(40))) for k in range(300)]
    counts, apply, write = {}, GroupedData.applyInArrow, suffix_dedup.written

    def applied(self, func, schema):
        if schema == suffix_dedup.MARKED:
            counts["strings"] = self._df.count()
        return apply(self, func, schema)

    def kept(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(GroupedData, "applyInArrow", applied)
    monkeypatch.setattr(suffix_dedup, "written", kept)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i: x[0][1] for i, x in brute_cut(rows).items()} == got
    assert 0 < counts["spans"] <= 8 * 32
    assert 0 < counts["strings"] <= 32 * 32
    assert 0 < counts["marks"] <= 32 * 32


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, width int")


@pytest.mark.parametrize(("inhabitants", "visitors"), [(100, 10**6), (100, 70), (10**6, 60)])
def test_embedding_dedup(spark, monkeypatch, inhabitants, visitors):
    """Tasks are cut by inhabitants and by visitors; the result is that of brute force."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", inhabitants)
    monkeypatch.setattr(embedding_dedup, "VISITOR_ROWS", visitors)
    base = rng.standard_normal((40, 64))
    x = np.vstack([base + rng.standard_normal((40, 64)) * s for s in (0, 0.2, 0.45, 0.5)] + [rng.standard_normal((200, 64)), base[:5], base[:5] * 3])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [1.0, 2.0]), (1004, [2.0, 4.0]), (1005, [None] * 64), (1006, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    close = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    roots = least(np.argwhere(close).tolist(), range(len(x)))
    assert all(got[k] == (int(close[k].sum()), roots[k], roots[k] == k) for k in range(len(x)))
    assert got[1003][:2] == got[1004][:2] == (1, 1003)
    assert all(got[k] == (0, k, True) for k in (1000, 1001, 1002, 1005, 1006))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_embedding_dedup_rare_widths_and_scales(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(240):
        v = rng.standard_normal(2 + k % 30) if k % 60 else rng.standard_normal(40)
        rows += [(4 * k, v.tolist()), (4 * k + 1, (v * 10.0 ** rng.integers(-180, 180)).tolist()), (4 * k + 2, (v + 0.1 * rng.standard_normal(len(v))).tolist())]
    rows.append((3, [1e-320, 0.0]))
    nothing = [(None, rows[0][1]), (None, None)]
    unit = {i: (x := np.array(v) / np.abs(v).max()) / np.sqrt(x @ x) for i, v in rows}
    pairs = [(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    roots, links = least(pairs, unit), defaultdict(int)
    for i, _ in pairs:
        links[i] += 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, rows + nothing)).collect()}
    assert got == {None: (0, None)} | {i: (links[i], roots[i]) for i in unit}


def brute_top(rows, k=10):
    """By integers of any size; products are held in the range of a long."""
    e = {i: [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v] for i, v in rows}
    out = []
    for q in sorted(e):
        if q % 100 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e[q], v, strict=True)))), i) for i, v in e.items() if i != q and len(v) == len(e[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("large", ["queries", "candidates", "both", "all", "widths"])
def test_top_k_of_any_magnitude(spark, large):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 6))
    x[450:] = x[449]
    pick = {"queries": [100, 300], "candidates": [7, 50, 333], "both": [0, 100, 101, 202], "all": range(500), "widths": [200, 201]}[large]
    for k in pick:
        x[k] *= rng.choice([3e6, 3e9, 1e13])
    if large == "both":
        x[400], x[401] = 1e300, -1e300
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    if large == "widths":
        rows = [(k, v[: 1 + k % 5] if k % 7 == 0 else v) for k, v in rows]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == brute_top(rows)


def test_top_k_tasks_are_bounded(spark, monkeypatch):
    """However many queries reach a cell, a task gets a block of them."""
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(6)
    rows = [(100 * k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 4)))]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == brute_top(rows)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((350, 8)), np.repeat(rng.standard_normal((1, 8)), 60, 0)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (600, [float("inf")] * 8), (700, [None] * 8), (800, [1.0, 2.0])]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect()))
    e = np.floor(1024 * x).astype(np.int64)
    wanted = []
    for q in range(0, len(x), 100):
        scored = sorted((-int(e[q] @ e[k]), k) for k in range(len(x)) if k != q)[:10]
        wanted += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert got == sorted(wanted)
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in topk.top_k(vectors(spark, [(0, [1.0]), (3, [2.0])])).collect()] == [(0, 1, 3, 1024 * 2048)]
