"""The operators as stages over documents: each takes (spark, docs, sf_dir) and returns documents, the
last one sequences. Null texts count as empty, empty tables give empty tables. Rows with a null id go
through all stages: they are judged by their text, are in no group of near duplicates, lose no bytes to
other documents, and are taken and packed like others. Rows that repeat an id count each by its own text,
but for the second stage, which keeps one of equal rows. Columns besides those of documents are dropped,
whatever their names. Very long texts are read whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard, mixing, packing, suffix_dedup, toxicity
from threadloom.llm.common import batches, fresh_worker, table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(docs: DataFrame) -> DataFrame:
    types = dict(x.split(" ") for x in COLUMNS.split(", "))
    return docs.select(*[F.col(c).cast(types[c]).alias(c) for c in _NAMES])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the rest go. Repeated rows have one score, so all or none of
    them stay; null and empty texts stay as long as a text without any suspicious word does."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    fresh_worker()  # the driver keeps the model only

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = toxicity.scorer_of(model)
        for b in batches(it, 200):
            yield b.filter(pa.array(scorer.scores([x or "" for x in b.column(1).to_pylist()]) < 0.5))

    return documents(docs).mapInArrow(run, COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near duplicates; repeated rows go as well.
    Rows with a null id stay, each text once."""
    docs = documents(docs)
    stay = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document of a smaller id has already; characters that a cut splits
    go too. Documents stay, if need be with an empty text."""
    docs = documents(docs)
    cut = suffix_dedup.deduplicate(docs, with_text=True).where("n_removed > 0").select("doc_id", "text_hash", "kept").dropDuplicates(["doc_id", "text_hash"])
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1000):
            texts = [t if k is None else k.decode("utf-8", "ignore") for t, k in zip(b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array([None if t is None else len(t) for t in texts], pa.int64())], _NAMES)

    return hashed.join(cut, ["doc_id", "text_hash"], "left").select(*_NAMES, "kept").mapInArrow(run, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; the last one that a budget reaches is cut
    after so many words and is a prefix of its text. Texts without words are taken no times; repeated rows are
    taken each for itself, also those with equal keys, whose order is that of their texts."""
    docs = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    plan = mixing.mix(docs, with_source=True).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "taken")
    plan = plan.withColumn("_nth", F.expr("row_number() over (partition by _id, _source, _size order by taken desc)"))
    rows = docs.withColumn("size", mixing.words(F.col("text"))).where("size > 0").withColumn("nth", F.expr("row_number() over (partition by doc_id, source, size order by text_hash)"))
    taken = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("nth") == F.col("_nth")))
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.when(rest > 0, whole + 1).otherwise(whole).cast("int")
    out = taken.withColumn("rest", rest).withColumn("whole", whole).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    # the place where the first word that isn't taken begins
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("rest").cast("int") + lead), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(F.col("copy") > F.col("whole"), part).otherwise(F.col("text"))
    return out.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset; a null or empty text is one end mark, and
    repeated rows have places of their own."""
    return packing.pack(docs)
