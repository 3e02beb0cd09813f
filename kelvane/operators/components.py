"""Connected components of pairs, in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvane.sources.store import ensure_checkpoint_dir


def connected(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """pairs (a, b) of longs -> (node, root): the smallest node that pairs reach, for every node that is not its own root.

    Each round links every node's neighbours to the smallest of them, first the larger ones, then the smaller ones, until nothing changes (Kiveris
    et al., "Connected Components in MapReduce and Beyond", 2014). Raises when ``max_rounds`` are not enough.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    high_low = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    table = pairs.where("a <> b").select(*high_low(F.col("a"), F.col("b"))).distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        now = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        larger = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        others = larger.join(least, F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        table = others.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
