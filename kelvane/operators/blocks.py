"""Entity blocks of a two-level table: one header row and any number of detail rows per entity.

Rows carry an explicit ``row_idx``; nothing depends on the physical order. Grouping is one aggregation by block key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvane.config import COMPANY_FIELDS, MASTER, RowModel
from kelvane.functions import text as X


def _is_head(model: RowModel) -> Column:
    return F.coalesce(F.col(model.kind) == model.header_kind, F.lit(False))


def block_key(model: RowModel = MASTER) -> Column:
    """id:<whole number>, id:<text> or name:<lower-case name>."""
    raw = F.col(model.entity_id).cast("string")
    whole = X.whole_number(F.col(model.entity_id)).cast("string")
    return F.when(~X.is_missing(raw), F.concat(F.lit("id:"), F.coalesce(whole, raw))).otherwise(F.concat(F.lit("name:"), F.lower(X.strip(X.as_text(F.col(model.entity))))))


def with_blocks(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """Adds block_key and is_header: the first header-kind row of each block; later ones count as details.

    The first header rows are aggregated and joined back by block and row, so that the rows of a large block are not one task's.
    """
    keyed = df.withColumn("block_key", block_key(model)).withColumn("__h", _is_head(model))
    firsts = keyed.where("__h").groupBy(F.col("block_key").alias("__b")).agg(F.min(model.row_idx).alias("__first"))
    at_first = (F.col("block_key") == F.col("__b")) & (F.col(model.row_idx) == F.col("__first"))
    joined = keyed.join(firsts, at_first, "left")
    return joined.withColumn("is_header", F.col("__h") & F.col("__first").isNotNull()).drop("__h", "__b", "__first")


def blocks(df: DataFrame, model: RowModel = MASTER, carry: list[str] | None = None) -> DataFrame:
    """One row per block: block_key, first_idx, company, company_row, product_rows (in row order), row_indices.

    The aggregation holds a block's rows together; ``block_stats`` does without that where only counts are asked for.
    """
    columns = carry or [c for c in df.columns]
    row = F.struct(model.row_idx, *[F.col(f"`{c}`") for c in columns if c != model.row_idx])
    own = with_blocks(df, model).withColumn("__r", row)
    out = own.groupBy("block_key").agg(
        F.min(model.row_idx).alias("first_idx"), F.max(F.when(F.col("is_header"), F.col("__r"))).alias("company_row"),
        F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.col("__r")))).alias("product_rows"), F.array_sort(F.collect_list(model.row_idx)).alias("row_indices"),
        F.min_by(F.struct(F.col(model.entity_id).alias("i"), X.strip(X.as_text(F.col(model.entity))).alias("n")), model.row_idx).alias("__f"),
    )
    return out.withColumn("company_id", F.col("__f.i")).withColumn("company", F.col("__f.n")).drop("__f")


def _first_name(model: RowModel) -> Column:
    return F.min_by(X.strip(X.as_text(F.col(model.entity))), model.row_idx)


def first_rows(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """block_key, first_idx, b_company, b_id: a block is named by its first row."""
    keyed = df.withColumn("block_key", block_key(model))
    return keyed.groupBy("block_key").agg(F.min(model.row_idx).alias("first_idx"), _first_name(model).alias("b_company"), F.min_by(F.col(model.entity_id), model.row_idx).alias("b_id"))


def block_stats(df: DataFrame, model: RowModel = MASTER, named: bool = False) -> DataFrame:
    """block_key, first_idx, b_company (if ``named``: the first row's name), has_header, n_details, n_named_details; partial aggregation only."""
    keyed = df.withColumn("block_key", block_key(model)).withColumn("__h", _is_head(model))
    return keyed.groupBy("block_key").agg(
        F.min(model.row_idx).alias("first_idx"), *([_first_name(model).alias("b_company")] if named else []), F.max("__h").alias("has_header"), (F.count("*") - F.max("__h").cast("long")).alias("n_details"),
        F.count_if(~F.col("__h") & ~X.is_blank(F.col(model.detail))).alias("n_named_details"),
    )


def representative(df: DataFrame, model: RowModel = MASTER, carry: list[str] | None = None) -> DataFrame:
    """One row per block: its header, else its first detail, with first_idx, b_company (the first row's name) and n_details."""
    columns = [c for c in (carry or df.columns)]
    keyed = df.withColumn("block_key", block_key(model)).withColumn("__h", _is_head(model))
    rank = F.struct(F.when(F.col("__h"), 0).otherwise(1), F.col(model.row_idx))
    out = keyed.groupBy("block_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), rank).alias("r"), F.min(model.row_idx).alias("first_idx"), _first_name(model).alias("b_company"), (F.count("*") - F.max("__h").cast("long")).alias("n_details"))
    return out.select("block_key", "first_idx", "b_company", "n_details", "r.*")


def next_id(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """One row: the largest whole id, at least 0, plus one."""
    return df.agg((F.coalesce(F.max(F.greatest(X.whole_number(F.col(model.entity_id)), F.lit(0))), F.lit(0)) + 1).cast("long").alias("next_id"))


def missing_fields(df: DataFrame, fields: list[str], model: RowModel = MASTER, company_fields=COMPANY_FIELDS, zero_is_empty: bool = False) -> DataFrame:
    """block_key, missing: the fields a block lacks, in the given order.

    The detail name is missing without a named detail row; company-level fields are looked up on the representative row;
    any other field is missing if no row of the block fills it.
    """
    filled = lambda f: ~X.is_blank(F.col(f), zero_is_empty)
    keyed = df.withColumn("block_key", block_key(model)).withColumn("__h", _is_head(model))
    rank = F.struct(F.when(F.col("__h"), 0).otherwise(1), F.col(model.row_idx))
    has = []
    for i, f in enumerate(fields):
        if f == model.detail:
            # The first header row is none of the details, all later ones are.
            named, first = F.count_if(filled(f)), F.min_by(filled(f).cast("int"), F.when(F.col("__h"), F.col(model.row_idx)))
            has.append((named > F.coalesce(first, F.lit(0))).alias(f"f{i}"))
        elif f in company_fields:
            has.append(F.min_by(filled(f), rank).alias(f"f{i}"))
        else:
            has.append(F.max(filled(f)).alias(f"f{i}"))
    out = keyed.groupBy("block_key").agg(*has)
    return out.select("block_key", F.array_compact(F.array(*[F.when(~F.col(f"f{i}"), f) for i, f in enumerate(fields)])).alias("missing"))


def block_urls(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """block_key, urls: stripped addresses of rows whose cell begins with http, header first."""
    own = with_blocks(df, model).where(F.lower(X.as_text(F.col(model.url))).startswith("http"))
    one = F.struct((~F.col("is_header")).alias("d"), F.col(model.row_idx).alias("i"), X.strip(F.col(model.url)).alias("u"))
    return own.groupBy("block_key").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["u"]).alias("urls"))


def named_urls(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """(row_idx, name, url) of rows whose stripped cell begins with http."""
    url = X.strip(X.as_text(F.col(model.url)))
    return df.select(F.col(model.row_idx).alias("row_idx"), X.strip(X.as_text(F.col(model.entity))).alias("name"), url.alias("url")).where(F.lower(F.col("url")).startswith("http"))


def entity_names(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """Distinct (name, first row_idx) of cells that are not missing, stripped."""
    return df.where(~X.is_missing(F.col(model.entity))).groupBy(X.strip(F.col(model.entity).cast("string")).alias("name")).agg(F.min(model.row_idx).alias("row_idx"))
