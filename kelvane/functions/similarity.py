"""Ratcliff/Obershelp similarity, the one scalar that Spark lacks, as an Arrow-batched function.

It is not symmetric. Callers filter rows first: a Python function runs on all rows that reach it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kelvane.config import DOMAIN_THRESHOLD
from kelvane.functions import text as X


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of a and b; pairs that occur again in a batch are computed once."""
    seen: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else SequenceMatcher(None, *pair).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """What the ratio of strings of these lengths cannot exceed."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def with_domain_fit(df, domain: str, name: str, out: str = "fits"):
    """Adds whether a domain plausibly belongs to a name: one's core contains the other's, or they are alike.

    The similarity is computed only where containment does not settle it.
    """
    d, n = X.core(F.regexp_replace(F.col(domain), r"\.[^.]*$", "")), X.core(X.normalize_company(F.col(name)))
    df = df.withColumn("__d", d).withColumn("__n", n)
    d, n = F.col("__d"), F.col("__n")
    sure = (F.length(n) >= 4) & d.contains(n) | (F.length(d) >= 4) & n.contains(d)
    state = F.when((d == "") | (n == ""), F.lit(False)).when(sure, F.lit(True)).when(length_bound(d, n) < DOMAIN_THRESHOLD, F.lit(False))
    df = df.withColumn(out, state)
    settled = df.where(F.col(out).isNotNull())
    open_rows = df.where(F.col(out).isNull()).withColumn(out, ratio(F.col("__d"), F.col("__n")) >= DOMAIN_THRESHOLD)
    return settled.unionByName(open_rows).drop("__d", "__n")
