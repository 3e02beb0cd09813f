"""Exact dedup by distributed MSD radix partitioning: groups are split by successive bytes until they are single or ended.

A group is a set of texts with an equal prefix. Each round deals every open group by its next bytes (few at first,
then eight times as many, so that a text of n bytes takes log n rounds) together with the fact whether the text ends
there. A group of one is done; a group whose texts all ended in that round holds equal texts. Bytes are compared
as they are; the SHA-256 is an output only.

Skew: a group of equal texts, however large, is counted by partial aggregation, and its rows meet only three numbers
of a written table, in a join that AQE can split. Rows that are done leave their text behind. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read, sha256_of

FIRST, FACTOR = 48, 8


def radix_groups(docs: DataFrame, text: str = "text", *, first: int = FIRST, factor: int = FACTOR) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256 per row: keep_id is the largest doc_id among the rows of equal text.

    Null text counts as empty. Rows that repeat a doc_id count as rows; a null doc_id is smaller than any other and
    stays only in a group of null doc_ids. An empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), sha256_of(F.col(f"`{text}`")).alias("text_sha256"), F.lit(0).cast("long").alias("label"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("rest"))
    done, width = [], first
    while True:
        key = [F.col("label"), F.substring("rest", 1, width).alias("part"), (F.length("rest") <= width).alias("ended")]
        cut = rows.select("doc_id", "text_sha256", *key, F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # Written, so that the number of a group holds, and that the join below has two plain exchanges, of which AQE can split a large group.
        groups = scratch.keep(rows.select("doc_id", *key).groupBy("label", "part", "ended").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("number", F.monotonically_increasing_id()))
        told = cut.join(groups, ["label", "part", "ended"]).withColumn("open", ~F.col("ended") & (F.col("group_size") > 1))
        table = scratch.keep(told.select("doc_id", "text_sha256", "group_size", "keep_id", "open", F.when(F.col("open"), F.col("number")).alias("label"), F.when(F.col("open"), F.col("rest")).alias("rest")))
        scratch.drop(groups)
        done.append(table.where("not open").select("doc_id", "keep_id", "group_size", "text_sha256"))
        rows = table.where("open").select("doc_id", "text_sha256", "label", "rest")
        if rows.isEmpty():
            break
        width *= factor
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = radix_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
