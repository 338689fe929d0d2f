import hashlib
import importlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from threadloom.llm import jaccard, mixing, packing, stages, suffix_dedup, toxicity
from threadloom.llm.queries import ORACLE_SQL, QUERIES
from threadloom.llm.shingles import Shingler

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    show = lambda x: f"{x:.8g}" if isinstance(x, float) else str(x)
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(show, r)) for r in cursor.fetchall())


def test_stages(spark):
    """Each stage against a plain version of what it does to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        steps[name] = (docs.collect(), rows)
        if name != "best_fit_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, out.schema)
    before, after = steps["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.Scorer(model).scores([r.text or "" for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s < 0.5)
    before, after = steps["ngram_jaccard_join"]
    shingler = Shingler(5)
    sets = {r.doc_id: set(shingler.set_of((r.text or "").encode()).tolist()) for r in before}
    kept = {r.doc_id for r in after}
    like = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    assert not [1 for a in kept for b in kept if a < b and like(sets[a], sets[b])]
    assert all(any(like(sets[i], sets[j]) for j in sets if j != i) for i in set(sets) - kept)
    before, after = steps["suffix_dedup"]
    seen, texts = set(), {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in sorted(before, key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        covered = {x for k, w in enumerate(windows) if w in seen for x in range(k, k + 50)}
        assert texts[r.doc_id] == bytes(c for k, c in enumerate(b) if k not in covered).decode("utf-8", "ignore")
        seen.update(windows)
    before, after = steps["mixing"]
    plan = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    taken = Counter()
    for r in after:
        taken[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in plan.items() if n} == dict(taken)
    before, after = steps["best_fit_packing"]
    words = packing.word_ids("word_bpe_49k.json")
    assert sum(r.length for r in after) == sum(len(words.of((r.text or "").encode())) // 4 + 1 for r in before)


def plain_pipeline(spark, docs):
    """Rows of run() for (doc_id, text, source) without nulls, step by step on the driver."""
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = [d for d in docs if scorer.scores([d[1]])[0] < 0.5]
    sets = {}
    for i, text, _ in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    docs = sorted(d for d in docs if root(d[0]) == d[0])
    seen, cut = set(), []
    for i, text, source in docs:
        b = text.encode()
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        covered = {x for k, w in enumerate(windows) if w in seen for x in range(k, k + 50)}
        seen.update(windows)
        cut.append((i, bytes(c for k, c in enumerate(b) if k not in covered).decode("utf-8", "ignore"), source))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    size = Counter()
    for _, text, source in cut:
        size[source] += len(words(text))
    weights, open_, target, rest = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}, set(size), {}, 1.5 * sum(size.values())
    while open_:  # full sources give their excess to the others
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2.0 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else level * weights[s]
            rest -= target[s]
        open_ -= full or open_
    mixed = []
    for source in size:
        left = int(target[source] + 1e-9)
        own = sorted((d for d in cut if d[2] == source), key=lambda d: hashlib.md5(f"mix{d[0]}".encode()).hexdigest())
        while left and size[source]:
            for i, text, _ in own:
                n = len(words(text))
                if left and n:
                    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                    mixed.append((i, text if n <= left else text[: ends[left - 1]]))
                    left -= min(n, left)
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces = []
    for i, text in mixed:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        pieces += [(i, k // 2048, k, len(part := ids[k : k + 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    bins = []
    for n in sorted((p[3] for p in pieces), reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(2048 - n)
    return Counter(pieces), len(bins)


def test_run_by_brute_force(spark):
    """run()'s pieces are those of a plain version of all stages, in as few sequences, without gaps."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None and r.source is not None]
    assert len(docs) == spark.read.parquet(f"{SF}/documents.parquet").count()
    pieces, bins = plain_pipeline(spark, docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == bins
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_stages_take_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words in this text here", "en", "a", 1), (3, "same words in this text here", "en", "a", 1), (4, "z" * 200_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for wide in (docs.withColumn("extra", F.lit(1)), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert len(stage(spark, wide, SF).collect()) <= 2 * len(rows) + 100, name


def test_stages_keep_rows_without_id(spark):
    """Clean rows with a null id go through every stage, whatever their source; the words of a source stay its own."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, words(1, 20), "en", "a", 1), (None, words(2, 20), "en", None, 1), (None, words(3, 20), "en", "b", 1), (None, None, "en", "a", 0), (None, words(1, 20), "en", "a", 1), (7, words(7, 20), "en", "a", 1), (8, words(8, 20), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = [r[1] for r in rows]
    assert sorted(r.text or "" for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()) == sorted(t or "" for t in texts)
    docs = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert sorted(r.text or "" for r in docs.collect()) == sorted({t or "" for t in texts})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    cut = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
    assert sorted(r.text or "" for r in cut) == sorted({t or "" for t in texts})
    plan, taken = Counter(), Counter()
    for r in mixing.mix(docs, with_source=True).collect():
        plan[r.source] += r.taken
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert taken == plan
    assert set(taken) == {"a", "b", None}
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    assert sum(r.start == 0 for r in corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()) == mixed.count()


def test_rows_without_id_link_others(spark):
    """1 and 2 are alike only to a row between them that has no id."""
    base = [f"w{i}" for i in range(104)]
    text = lambda a, b: " ".join([*(f"a{i}" for i in range(a)), *base[a : 104 - b], *(f"b{i}" for i in range(b))])
    docs = spark.createDataFrame([(1, text(8, 0)), (None, text(0, 0)), (None, text(0, 0)), (2, text(0, 8)), (None, "far from all of the others")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, 1), (None, 1), (None, None)]
    assert {r.component_id for r in jaccard.join(docs.where("doc_id is not null")).collect()} == {1, 2}


def test_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert suffix_dedup.WIDTH == 50


def test_entry_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the rest still imports."""
    root = Path(entry.__file__).parent
    for name in ("threadloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "threadloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_third_stage_packs_rows(spark, monkeypatch):
    """Rows between texts and indexes go by pairs of home and bucket or group, not by document and part."""
    rng = random.Random(4)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(1000)]
    rows = [(k, "".join(rng.choice(passage) for _ in range(20)), "en", "web", 1800) for k in range(300)]
    counts, write = {}, suffix_dedup.written

    def kept(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", kept)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        out = {r.doc_id: r.text for r in stages.cut_repeats(spark, spark.createDataFrame(rows, stages.COLUMNS), "").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(out) == 300
    assert out[0] == rows[0][1]
    assert sum(map(len, out.values())) < 100_000
    assert 0 < counts["spans"] <= 4 * 16
    assert 0 < counts["marks"] <= 16 * 16 + 4 * 16
