import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.reference.QUERIES)))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())
    if name in entry.oracle_sql():
        cursor = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted("|".join(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def split_brute(text, limit):
    """Paragraphs packed while they fit; longer ones cut at the last line end or blank of the second half."""
    white = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    if len(text) <= limit:
        return [text]
    paragraphs, own = [], []
    for line in [*text.split("\n"), ""]:
        line = line.removesuffix("\r")
        if line.strip(white):
            own.append(line)
        elif own:
            paragraphs.append("\n".join(own))
            own = []
    packed = []
    for p in paragraphs:
        if packed and len(packed[-1]) + 2 + len(p) <= limit:
            packed[-1] += "\n\n" + p
        else:
            packed.append(p)
    out = []
    for p in packed:
        p = p.strip(white)
        while len(p) > limit:
            cut = [k for k in range(limit // 2, limit) if p[k] == "\n"] or [k for k in range(limit // 2, limit) if p[k] == " "] or [limit]
            out.append(p[: cut[-1]].strip(white))
            p = p[cut[-1] :].strip(white)
        out.append(p)
    return [x for x in out if x]


def test_chunk_split_by_brute_force(spark):
    got = {}
    for r in entry.queries()["chunk_split"](spark, SF).orderBy("doc_id", "part_index").collect():
        assert r.n_chars == len(r.part)
        got.setdefault(r.doc_id, []).append(r.part)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    assert got == {i: split_brute(t, 800) for i, t in texts.items() if split_brute(t, 800)}


def test_stub_embeddings_by_brute_force(spark):
    """Every vector has its width and length one; equal texts have equal vectors (by their norms here)."""
    rows = entry.queries()["stub_embedding_norm"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert {(r.width, r.norm) for r in rows} == {(64, 1.0)}


@pytest.mark.parametrize("layout", ["parts", "keys"])
def test_stream_equals_batch_of_a_folder(spark, duck, tmp_path, layout):
    """A table of several files, or with a folder for each role, gives the rows that a single file gives."""
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    writer = table.repartition(3).write if layout == "parts" else table.write.partitionBy("role")
    writer.parquet(f"{tmp_path}/conversations.parquet")
    rows = entry.queries()["stream_equals_batch"](spark, str(tmp_path)).select("session_id", "n_turns").collect()
    assert sorted(map(tuple, rows)) == sorted(duck.execute(entry.oracle_sql()["stream_equals_batch"]).fetchall())
