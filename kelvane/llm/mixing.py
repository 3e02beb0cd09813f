"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source may give at most ``max_epochs`` times its size. The level ``lam`` at which
``sum(min(cap, lam * weight))`` meets the budget is what repeated clamping and proportional
resharing converges to; it is found in one pass over the sources sorted by ``cap / weight``.
A source then takes every document ``floor(target / size)`` times and spends the rest on one more,
seeded repetition: documents in the order of a seeded digest, the last one in part.

Skew: a source's documents are dealt to 4096 digest buckets, so that no window or join group holds
more than 1/4096 of a source; only sums per source and bucket meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelvane.llm.common import WORD, read

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Weights repeat over the sources in code-point order, null last. A source of size 0 has the target 0.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    zero = F.lit(0.0)
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(everything))
        .withColumn("left_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("lam", (F.col("total") - F.coalesce(F.sum("cap").over(before), zero)) / F.col("left_w"))
        .withColumn("target", F.least("cap", F.col("weight") * F.max("lam").over(everything)))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, size: Column, *, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, part, taken: how much of each row the mix takes.

    ``whole`` repetitions of the document and ``part`` further words of it make ``taken`` words. The taken
    words of a source differ from its target by less than one word, and rows of equal doc_id are interchangeable.
    Null doc_id counts as an id of its own; an empty table gives an empty result; other columns of ``docs`` are ignored, or kept
    as one struct column ``row`` with ``carry``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", size.alias("size"), *row).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").cast("long").alias("source_size")), weights, budget, max_epochs)
    prior = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = (
        sums.withColumn("prior", prior)
        .join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("reps", F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)))
        .select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "prior", "source_size", "target", "reps", (F.floor("target") - F.col("reps") * F.col("source_size")).alias("need"))
    )
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.withColumn("inside", inside)
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("prior") - F.col("inside"))).cast("long"))
        .withColumn("whole", (F.col("reps") + ((F.col("extra") == F.col("size")) & (F.col("size") > 0)).cast("long")).cast("long"))
        .withColumn("part", F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(F.lit(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), *(["row"] if carry else []))
    )


def repeated(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, and once more with the first words of its text for a part."""
    mixed = mix(docs, word_count(F.col(f"`{text}`")), carry=True, **options)
    words = F.filter(F.split(F.col(f"row.`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.when(F.col("part") > 0, F.array(F.col("row").withField(f"`{text}`", F.array_join(F.slice(words, 1, F.col("part").cast("int")), " "))))
    # A row without words counts for nothing in the mix; it stays as it is.
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("whole")).cast("int")
    return mixed.select(F.explode(F.concat(F.array_repeat("row", times), F.coalesce(first, F.filter(F.array("row"), lambda r: F.lit(False))))).alias("row")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
n AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ()) AS total FROM n),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lam FROM f WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(lam) OVER ()) AS target FROM l),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS reps FROM t),
c AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.reps, floor(p.target)::BIGINT - p.reps * p.source_size AS need,
  coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (reps * size + greatest(0, least(size, need - before)))::BIGINT AS taken FROM c
"""
