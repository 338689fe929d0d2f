"""Operator 3, mixing sources to target weights.

Each row gets a hash-random key and rows are ordered by it within their source. Prefix sums of sizes
are distributed: the leading hex digits of the key cut each source into 4096 ranges, sums per range
are added up over the ranges, and running sums stay inside a range; a source that holds a third of
all rows is therefore 4096 groups. The last document that a source's budget reaches is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range.
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row per source. Weights repeat along the sources in
    code point order, null last. Targets are weight * level, or ``most`` times the source's size
    where that is less; the level makes their sum ``share`` of all sizes (water filling)."""
    everything = W.partitionBy(F.lit(1))
    ranked = sizes.withColumn("k", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), "k")
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (share * F.col("total") - most * F.col("capped")) / F.col("open"))
    )
    # sources in order of size / weight are full as long as the level that the rest would get tops theirs
    found = level.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))).over(everything))
    return found.select("source", "source_size", F.coalesce(F.least(F.col("final") * F.col("weight"), most * F.col("source_size")), most * F.col("source_size")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", with_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``; ``with_source`` adds ``source``.

    ``taken`` counts words with repeats: every whole epoch that fits the target, then the rest in the
    order of the key, the last document in part, so that a source's sum is its target rounded down.
    A null source is a source of its own; null and empty texts have size 0 and give 0; rows that
    repeat an id each count; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size")).withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")))
    rows = rows.withColumn("part", F.substring("key", 1, RANGE_DIGITS)).withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rows = written(rows, "mix")
    parts = rows.groupBy("name", "part").agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    parts = written(parts, "mix-parts")
    targets = source_targets(parts.groupBy("name").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size")), weights, share, most)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    before = W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = parts.select("name", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base")).join(targets, "name")
    inside = W.partitionBy("name", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(based, ["name", "part"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("base") - F.col("within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["source"] if with_source else []))


ORACLE_SQL = """
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), '-'))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
v AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
f AS (SELECT *, max(CASE WHEN level * weight <= 2.0::DOUBLE * source_size THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, coalesce(least(final * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM f),
p AS (SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
     + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)) AS BIGINT) AS taken
FROM p
"""
