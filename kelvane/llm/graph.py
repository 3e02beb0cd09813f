"""Connected components of links that no machine has to hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch


def contract(pairs: Iterator[tuple], flush_at: int = 400_000) -> Iterator[list[tuple]]:
    """Replaces pairs by stars with the same components, so many at a time; each star's centre is its smallest node."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent[root]) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
        if len(parent) >= flush_at:
            yield [(x, find(x)) for x in parent if find(x) != x]
            parent.clear()
    yield [(x, find(x)) for x in parent if find(x) != x]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = ((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for star in contract(pairs):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in star], pa.int64()), pa.array([y for _, y in star], pa.int64())], ["src", "dst"])


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """edges (src, dst) of longs -> (node, root): the smallest node of each component; nodes that are roots are left out.

    Links are first contracted to stars within each task, then alternating large-star and small-star steps (Kiveris et
    al., 2014) run until the table stays the same. A hub's links meet only its minimum, in a join that AQE can split.
    """
    table = scratch.keep(edges.select("src", "dst").mapInArrow(_contract_batches, "src long, dst long").distinct())

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = state(table)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = table.unionByName(table.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
        large = both.join(low, F.col("src") == F.col("u")).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Now every pair points downwards: src > dst.
        low = large.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
        kept = large.join(low, F.col("src") == F.col("u"))
        small = kept.where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct()
        old, table = table, scratch.keep(small)
        scratch.drop(old)
        before, now = now, state(table)
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return table.select(F.col("src").alias("node"), F.col("dst").alias("root"))
