"""Mixing sources to target weights by hash thresholds found in histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.session import materialise

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
HASH_BITS = 60
LEVEL_BITS = 12  # a level splits a bucket in 4,096
SMALL_ROWS = 100_000  # threshold rows (one per source) up to which they are broadcast, about 6 MB
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null counts as empty."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("bigint")


def position_hash(id_column: Column) -> Column:
    """60-bit hash of a document id, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: weights repeat over the sources in code-point
    order, null last; targets share the total size by weight, none above ``repeats`` times its source's size.

    The excess of sources at their limit is reshared among the others until none is above.  Sources are ranked
    in range partitions plus the number of sources in the partitions before, so no task holds them all.
    """
    ranged = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged, "sources")
    inside = ranged.selectExpr("*", "row_number() OVER (PARTITION BY _p ORDER BY source NULLS LAST) AS _r")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.selectExpr("_p", "coalesce(sum(_n) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_before") + F.col("_r") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(inside.join(before, "_p").select("source", "source_size", weight.alias("weight")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * float(repeats)
    share = 0.0
    while True:  # the share of one unit of weight only grows, so a source once at its limit stays there
        full = limit < F.col("weight") * share if share else F.lit(False)
        taken, free = rows.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - taken) / free if free else share
        if new <= share:
            break
        share = new
    return rows.select("source", "source_size", F.least(limit, F.col("weight") * share).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, threshold)``: hashes below it make up each source's ``budget`` as nearly as whole hashes can.

    ``rows`` is (source, hash, size), ``budgets`` (source, budget) with 0 <= budget < the source's size.  Sizes are
    summed by source and bucket of the leading hash bits; the bucket in which the running sum passes the budget is
    split by the next bits, until it is one hash value, which is taken in if that comes nearer.  Only the boundary
    bucket of each source is read again, and nothing is sorted but bucket sums, at most 4,096 of a source.
    """
    bounds = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    bounds, shift = materialise(bounds, "bounds"), HASH_BITS
    while shift > 0:
        named = small(bounds.select(F.col("source").alias("_s"), "budget", "prefix", "below"))
        inside = rows.join(named, rows["source"].eqNullSafe(F.col("_s")))
        if shift < HASH_BITS:
            inside = inside.filter(F.shiftright("hash", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("below").alias("below"),
            F.min("hash").alias("low"), F.max("hash").alias("high"),
        )
        running = buckets.selectExpr("*", "below + sum(size) OVER (PARTITION BY source ORDER BY prefix) AS upto")
        cut = F.struct("prefix", (F.col("upto") - F.col("size")).alias("below"), "upto", "low", "high")
        passed = running.filter("upto > budget").groupBy("source").agg(F.first("budget").alias("budget"), F.min(cut).alias("cut"))
        bounds = materialise(passed.select("source", "budget", "cut.*"), "bounds")
        if bounds.filter("low < high").isEmpty():
            break
    nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("below")
    return bounds.select("source", (F.col("high") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if it is counted to be small; else the join decides."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def mix_plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target, whole, threshold)`` from ``(source, hash, size)``.

    Every document of a source is taken ``whole`` times, those with a hash below ``threshold`` once more: the
    repeats are nested, so a larger target keeps all that a smaller one took.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    planned = targets.withColumn("whole", whole)
    budgets = planned.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).filter("budget > 0")
    cut = hash_thresholds(rows, budgets).select(F.col("source").alias("_s"), "threshold")
    joined = planned.join(cut, planned["source"].eqNullSafe(F.col("_s")), "left")
    return materialise(joined.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")), "plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``hash``) joined with their source's plan; ``copies`` is how often each is taken."""
    named = small(plan.withColumnRenamed("source", "_s"))
    joined = rows.join(named, rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("copies", F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", position_hash(F.col("doc_id")).alias("hash"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``docs`` (doc_id, text, source).

    ``size`` counts words, ``taken`` the words the mix takes of the document, repeats counted.  A null source is
    one, the last; null and empty texts have size 0; rows of equal or null id share a hash and so one decision; a source
    of size 0 has target 0; no rows give no rows; other columns are not read.  Texts are read once: the narrow table
    (id, source, hash, size) is written, and histograms and the result come from it.
    """
    rows = materialise(sized(docs), "sizes")
    mixed = with_copies(rows, mix_plan(rows, weights, repeats))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows of ``docs`` with all their columns, each as often as the mix takes it."""
    plan = mix_plan(materialise(sized(docs), "sizes"), weights, repeats)
    rows = docs.select(F.struct("*").alias("_row"), "source", position_hash(F.col("doc_id")).alias("hash"))
    taken = with_copies(rows, plan).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


OP4_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS hash FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows_ GROUP BY source),
shares AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS share
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(3.0 * source_size) FILTER (WHERE 3.0 * source_size < weight * share), 0))
    / sum(weight) FILTER (WHERE NOT 3.0 * source_size < weight * share) FROM sources)::DOUBLE FROM shares
  WHERE step < 40),
targets AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT max(share) FROM shares))::DOUBLE AS target FROM sources),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
groups_ AS (SELECT r.source, r.hash, sum(sum(r.size)) OVER (PARTITION BY r.source ORDER BY r.hash) AS upto, sum(r.size) AS size
  FROM rows_ r GROUP BY r.source, r.hash),
cuts AS (SELECT p.source, min({{'h': g.hash, 'upto': g.upto, 'below': g.upto - g.size, 'budget': p.target - p.whole * p.source_size}}) AS c
  FROM groups_ g JOIN plans p ON g.source IS NOT DISTINCT FROM p.source
  WHERE p.target - p.whole * p.source_size > 0 AND g.upto > p.target - p.whole * p.source_size GROUP BY p.source),
limits AS (SELECT p.*, CASE WHEN c.c IS NULL THEN 0 WHEN c.c.upto - c.c.budget <= c.c.budget - c.c.below THEN c.c.h + 1 ELSE c.c.h END AS threshold
  FROM plans p LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM p.source)
SELECT r.doc_id, r.size, l.source_size, l.target, CAST(r.size * (l.whole + CASE WHEN r.hash < l.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows_ r JOIN limits l ON r.source IS NOT DISTINCT FROM l.source
"""


@query("op4_mix_sources", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
