import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing, packing, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, length long, piece string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "k", 2, "x") for i, t, s in rows], DOCS)


def brute_bins(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 50, 100])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    assert packing.best_fit_plan(Counter(items), capacity)[1] == brute_bins(items, capacity)


def test_tree_finds_the_tightest():
    tree, there = packing.CapacityTree(100), set()
    rng = random.Random(1)
    for _ in range(2000):
        r = rng.randint(0, 100)
        there ^= {r}
        tree.put(r, r in there)
        s = rng.randint(0, 100)
        assert tree.first(s) == min((x for x in there if x >= s), default=None)


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), packing.word_ids("word_bpe_49k.json")
    rng = random.Random(2)
    letters = ["a", "B", "É", "\u0301", " ", "\t", "\x0b", "\x1c", "\u3000", "1", "'s", "'LL", "!", "<|endoftext|>", "<|", "ß", "ΑΣ", "İ", "中", "😀", "\x00", "x", ".", ",", ")"]
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert words.of(s.encode()) == np.asarray(whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta,", "Gamma"]) for _ in range(rng.choice([0, 3, 40, 900, 5000]))), "s") for k in range(60)]
    rows += [(100, None, None), (101, "", "s"), (0, rows[0][1], "s"), (None, "null id", "s")]
    got = packing.pack(frame(spark, rows), capacity=2048).collect()
    words = packing.word_ids("word_bpe_49k.json")
    wanted = Counter()
    for i, t, _ in rows:
        ids = words.of((t or "").encode()) + b"\0\0\0\0"
        for piece, at in enumerate(range(0, len(ids), 8192)):
            part = ids[at : at + 8192]
            wanted[i, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1])
        assert sum(n for _, n in own) <= 2048
    assert len(bins) == brute_bins([r.length for r in got], 2048)
    assert packing.pack(frame(spark, [])).count() == 0


def test_mix(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(300)]
    rows += [(300, None, "a"), (301, "\x0bone\u00a0word ", "d"), (0, rows[0][1], rows[0][2])]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(spark, rows[::-1])).collect()))
    sizes, source = defaultdict(int), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    # brute-force water filling
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2.0 * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in open_) for s in names}
        more = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in names)
    assert {r.size for r in got if r.doc_id == 301} == {1}
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "", "a")])).collect()] == [0]


def test_automaton():
    rng = random.Random(5)

    patterns = ["a*b", "?c", "*.x\x00/p", "ab", "a**c?", "\\*a", "b" * 70 + "*c"]
    texts = ["".join(rng.choice("abc.x/*\x00") for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["b" * 75 + "ac", "é", ""]
    found = urls.WildcardAutomaton(patterns).matches([t.encode() for t in texts])

    def as_regex(p):
        out, k = "", 0
        while k < len(p):
            out += "[^\x00]*" if p[k] == "*" else "[^\x00]" if p[k] == "?" else re.escape(p[k + 1] if p[k] == "\\" else p[k])
            k += 1 + (p[k] == "\\")
        return re.compile(out, re.S)

    for t, row in zip(texts, found, strict=True):
        assert [bool(as_regex(p).match(t)) for p in patterns] == row.tolist(), t


def test_urls(spark):
    rows = ["http://A.Example.com/en/7x?q", "https://example.com/en/8", "http://xexample.com/en/8", "http://m.example.net/de/8", "ftp://b.net/de/7#t", "http://com/en/", "no scheme /en/", None, "http://h.com?x=/en/", "x://user@Y.ORG/es/", "http://evil.test/a.net/de/", "http://" + "a" * 3000 + ".org/es/", "é://É.com/en/"]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(rows)], "page_id long, url string, html string, host string")
    got = [(r.host[:20], r.path[:8], r.rule, r.verdict) for r in urls.filter_urls(df).orderBy("page_id").collect()]
    assert got[:11] == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("xexample.com", "/en/8", "com/en/", "block"), ("m.example.net", "/de/8", "example.net/de/8", "block"),
        ("b.net", "/de/7", "net/de/", "allow"), ("com", "/en/", "com/en/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.com", "", None, "allow"), ("user@y.org", "/es/", "org/es/", "block"), ("evil.test", "/a.net/d", None, "allow"),
    ]
    assert got[11][2:] == ("org/es/", "block")
    assert got[12] == ("É.com", "/en/", "com/en/", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert urls.filter_urls(df, rules=()).where(F.col("verdict") != "allow").count() == 0
