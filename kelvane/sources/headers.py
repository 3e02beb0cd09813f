"""Binding a table's headers to the contract: tens of strings, so plain Python on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvane.config import COLUMNS, SchemaError


def normalize_header(value) -> str:
    """NFKC, white space collapsed, lower case; null is empty."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", "" if value is None else str(value)).replace(" ", " ")).strip().lower()


def _stem(header: str) -> str:
    return re.split(r"[:(]", header, maxsplit=1)[0].strip()


def _fit(want: str, got: str) -> int | None:
    """0 for equal headers, 1 if one begins as the other does (up to a colon or bracket), None if neither."""
    if want == got:
        return 0
    short, own = _stem(want), _stem(got)
    return 1 if got and any(x.startswith(y) for x, y in ((got, short), (own, short), (short, own))) else None


def resolve_columns(headers: list, columns=COLUMNS) -> dict[str, int]:
    """field -> position, by falling fit: all equal headers first, then like beginnings, each in the order of the contract and of the table."""
    have = [normalize_header(h) for h in headers]
    fits = [(fit, f, i) for f, (_, header) in enumerate(columns) for i, got in enumerate(have) if (fit := _fit(normalize_header(header), got)) is not None]
    at: dict[int, int] = {}
    for _, f, i in sorted(fits):
        if f not in at and i not in at.values():
            at[f] = i
    if len(at) < len(columns):
        lacking = ", ".join(repr(header) for f, (_, header) in enumerate(columns) if f not in at)
        raise SchemaError(f"no header for {lacking} among {have}")
    return {field: at[f] for f, (field, _) in enumerate(columns)}


def bind(df: DataFrame, columns=COLUMNS, keep=("row_idx", "company_id_is_float")) -> DataFrame:
    """A table of any headers as one of fields; rows without any value go, also counting columns that are not bound."""
    names = [c for c in df.columns if c not in keep]
    at = resolve_columns(names, columns)
    some = F.lit(False)
    for c in names:
        some = some | (F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""))
    return df.where(some).select(*[c for c in keep if c in df.columns], *[F.col(f"`{names[i]}`").cast("string").alias(f) for f, i in at.items()])
