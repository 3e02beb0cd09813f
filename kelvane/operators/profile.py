"""Profiles and search: key figures, fill rates, histograms, top entities, faceted lists. Each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvane.config import FIELDS, MASTER, RowModel
from kelvane.functions import text as X
from kelvane.operators import blocks as B


def tier_histogram(df: DataFrame, column: str = "competitor_tier") -> DataFrame:
    """(tier, n) over all rows by stripped value, in code-point order."""
    tier = X.strip(X.as_text(F.col(column)))
    return df.select(tier.alias("tier")).where("tier != ''").groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier")


def kpis(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """rows, blocks, detail_rows (demoted header rows count), blocks_with_header, blocks_with_details."""
    per = B.block_stats(df, model).withColumn("n", F.col("n_details") + F.col("has_header").cast("long"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("blocks"), F.coalesce(F.sum("n_details"), F.lit(0)).cast("long").alias("detail_rows"),
        F.count_if("has_header").alias("blocks_with_header"), F.count_if(F.col("n_named_details") > 0).alias("blocks_with_details"),
    )


def fill_rates(df: DataFrame, fields=FIELDS, *, policy: str = "unknown") -> DataFrame:
    """(field, filled, total, pct): one pass for all fields; null rates for an empty table.

    policy ``unknown``: placeholders count as empty, one decimal; ``blank``: only blanks do, whole per cent rounded half to even.
    """
    empty = X.is_unknown if policy == "unknown" else X.is_blank
    one = df.agg(F.count("*").alias("total"), *[F.count_if(~empty(F.col(f))).alias(f"f_{f}") for f in fields])
    long = one.unpivot("total", [f"f_{f}" for f in fields], "field", "filled").withColumn("field", F.expr("substring(field, 3)"))
    share = 100.0 * F.col("filled") / F.expr("nullif(total, 0)")
    return long.select("field", "filled", "total", (F.round(share, 1) if policy == "unknown" else F.bround(share, 0)).alias("pct"))


def fill_bars(rates: DataFrame) -> DataFrame:
    """(field, pct, bar) with the emptiest fields first."""
    pct = F.coalesce("pct", F.lit(0.0)).cast("int")
    return rates.select("field", pct.alias("pct"), F.repeat(F.lit("#"), F.expr("cast(coalesce(pct, 0) as int) div 4").cast("int")).alias("bar")).orderBy("pct", "field")


def top_entities(df: DataFrame, n: int = 10, model: RowModel = MASTER) -> DataFrame:
    """(block_key, company, n_details) of the blocks with most detail rows; ties by first row."""
    return B.block_stats(df, model, named=True).orderBy(F.desc("n_details"), "first_idx").limit(n).select("block_key", F.col("b_company").alias("company"), "n_details")


def search(df: DataFrame, q: str = "", tier: str = "", model: RowModel = MASTER) -> DataFrame:
    """Blocks whose name contains q in any case and whose representative row's tier begins with tier, by lower-case name."""
    shown = [c for c in (model.entity, model.tier, "beachhead", "last_update") if c in df.columns]
    rows = B.representative(df, model, shown)
    if q:
        rows = rows.where(F.lower("b_company").contains(F.lower(F.lit(q))))
    if tier:
        rows = rows.where(X.as_text(F.col(model.tier)).startswith(tier))
    out = [F.col("b_company").alias("company"), X.as_text(F.col(model.tier)).alias("tier"), "n_details"]
    out += [F.col("beachhead")] if "beachhead" in shown else []
    out += [X.date_prefix(F.col("last_update")).alias("updated")] if "last_update" in shown else []
    return rows.orderBy(F.lower("b_company"), "first_idx").select(*out)


def lookup(df: DataFrame, name: str, model: RowModel = MASTER) -> DataFrame:
    """All rows of the first block of exactly this name, header first."""
    first = B.first_rows(df, model).where(F.col("b_company") == name).orderBy("first_idx").limit(1).select("block_key")
    return B.with_blocks(df, model).join(first, "block_key").orderBy(F.desc("is_header"), model.row_idx)


def render(df: DataFrame, name: str = "", model: RowModel = MASTER) -> str:
    """Key figures, tiers and fill rates as text; a row per tier and field reaches the driver."""
    k = kpis(df, model).first()
    lines = [f"{'table':16s}{name}", f"{'rows':16s}{k['rows']}", f"{'entities':16s}{k['blocks']}", f"{'detail rows':16s}{k['detail_rows']}"]
    lines += [f"  {r['tier']:24s}{r['n']}" for r in tier_histogram(df, model.tier).collect()]
    lines += [f"  {r['field']:20s}{'-' if r['pct'] is None else format(r['pct'], '5.1f')} %" for r in fill_rates(df).collect()]
    return "\n".join(lines)
