"""Staged edits: a basket of changed cells on one version, shown as differences and applied as overwrites.

Unlike merging, a curated edit may overwrite and clear. Edits are a long frame (row_idx, field, new_value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvane.config import FIELDS, ConflictError
from kelvane.functions import text as X

EDITABLE = tuple(f for f in FIELDS if f not in ("company_id", "row_kind"))


def check_base(basket_version: str | None, current: str) -> None:
    """Raises if the basket was staged on another version."""
    if basket_version and basket_version != current:
        raise ConflictError(f"the basket is based on {basket_version}, the current version is {current}")


def stage(master: DataFrame, form: DataFrame, basket: DataFrame | None = None, fields=EDITABLE) -> DataFrame:
    """Edits from submitted rows (row_idx and fields): cells that differ after stripping; a missing field clears its cell.

    Rows that the table does not have are ignored. Cells that are equal again do not leave an earlier edit: see ``unstage``.
    """
    old = master.select("row_idx", *[X.strip(X.as_text(F.col(f))).alias(f) for f in fields]).unpivot("row_idx", list(fields), "field", "old_value")
    missing = [f for f in fields if f not in form.columns]
    new = form.select("row_idx", *[X.strip(X.as_text(F.col(f))).alias(f) for f in fields if f in form.columns], *[F.lit("").alias(f) for f in missing]).unpivot("row_idx", list(fields), "field", "new_value")
    changed = new.join(old, ["row_idx", "field"]).where("new_value != old_value").select("row_idx", "field", "new_value")
    if basket is None:
        return changed
    kept = basket.join(changed.select("row_idx", "field"), ["row_idx", "field"], "left_anti")
    return kept.select("row_idx", "field", "new_value").unionByName(changed)


def unstage(basket: DataFrame, row_idx: int, field: str | None = None) -> DataFrame:
    """The basket without a row's edits, or without that of one field."""
    hit = F.col("row_idx") == row_idx
    return basket.where(~(hit & (F.col("field") == field)) if field else ~hit)


def differences(master: DataFrame, basket: DataFrame, fields=FIELDS, who=("company", "product_name")) -> DataFrame:
    """(row_idx, who, field, old_value, new_value) of the staged cells."""
    name = F.concat_ws(" / ", X.as_text(F.col(who[0])), F.when(~X.is_blank(F.col(who[1])), F.col(who[1]))) if len(who) > 1 else X.as_text(F.col(who[0]))
    old = master.withColumn("__who", name).select("row_idx", "__who", *[F.col(f).cast("string").alias(f"v_{f}") for f in fields])
    long = old.unpivot(["row_idx", "__who"], [f"v_{f}" for f in fields], "__f", "old_value").select("row_idx", F.col("__who").alias("who"), F.expr("substring(__f, 3)").alias("field"), "old_value")
    return basket.join(long, ["row_idx", "field"]).select("row_idx", "who", "field", "old_value", "new_value")


def staged_count(basket: DataFrame) -> DataFrame:
    return basket.agg(F.count("*").alias("staged"))


def apply_edits(master: DataFrame, basket: DataFrame, *, today: str | None = None, fields=FIELDS) -> DataFrame:
    """Overwrites the staged cells, empty ones with null, and stamps last_update of the rows touched."""
    per_row = basket.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("field", "new_value"))).alias("__e")).withColumnRenamed("row_idx", "__k")  # one entry per field at most
    out = master.join(per_row, F.col("row_idx") == F.col("__k"), "left")
    cell = lambda f: F.when(F.map_contains_key("__e", f), F.expr(f"nullif(__e['{f}'], '')").cast(master.schema[f].dataType)).otherwise(F.col(f))
    stamp = lambda: F.when(F.col("__k").isNotNull(), F.lit(today)).otherwise(F.col("last_update"))
    return out.select(*[stamp().alias(c) if today and c == "last_update" else cell(c).alias(c) if c in fields else F.col(c) for c in master.columns])
