"""Controlled vocabularies: loading them, looking values up, reporting what is unknown.

A vocabulary is bounded by its file (tens of entries), so lookups are map literals in the plan and need no join;
``terms`` gives the same as a table for joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.config import SEPARATORS
from kelvane.functions import text as X

DEFAULT = Path(__file__).resolve().parents[1] / "resources" / "vocabulary.yaml"


@dataclass(frozen=True)
class Vocabulary:
    """Allowed values in their order, aliases (to null: discard), and which sub-values each key value allows."""

    key_categories: tuple[str, ...] = ()
    key_category_aliases: dict = field(default_factory=dict)
    sub_categories: tuple[str, ...] = ()
    sub_category_aliases: dict = field(default_factory=dict)
    legend: dict = field(default_factory=dict)
    tiers: tuple[str, ...] = ()
    beachhead: tuple[str, ...] = ()
    lfl_dimension: tuple[str, ...] = ()
    r_strategies: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str | Path = DEFAULT) -> Vocabulary:
        import yaml

        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        many = lambda k: tuple(data.get(k) or ())
        return cls(many("key_categories"), data.get("key_category_aliases") or {}, many("sub_categories"), data.get("sub_category_aliases") or {}, data.get("legend") or {}, many("competitor_tier"), many("beachhead_relevanz"), many("lfl_dimension"), many("r_strategies"))

    def lists(self, name: str) -> tuple[tuple[str, ...], dict]:
        return {"key_categories": (self.key_categories, self.key_category_aliases), "sub_category": (self.sub_categories, self.sub_category_aliases), "beachhead": (self.beachhead, {})}[name]

    def subs_for(self, key: str) -> tuple[str, ...]:
        """Sub-values of a key value; all of them for an unknown key."""
        return tuple(self.legend.get(key, self.sub_categories))

    def terms(self, spark: SparkSession) -> DataFrame:
        """(domain, lower_key, canonical, priority): allowed values before aliases."""
        rows = []
        for domain in ("key_categories", "sub_category", "beachhead"):
            allowed, aliases = self.lists(domain)
            rows += [(domain, _folded(v), v, i) for i, v in enumerate(allowed)]
            rows += [(domain, _folded(a), c, len(allowed) + i) for i, (a, c) in enumerate(aliases.items())]
        return spark.createDataFrame(rows, "domain string, lower_key string, canonical string, priority int")


def _folded(value: str) -> str:
    return " ".join(value.split()).lower()


def lookup(value: Column, allowed, aliases=None) -> Column:
    """The canonical form of a value: an allowed one in any case and spacing, else an alias's target; else null."""
    table: dict[str, str | None] = {}
    for v in allowed:
        table.setdefault(_folded(v), v)
    for a, c in (aliases or {}).items():
        table.setdefault(_folded(a), c)
    known = {k: v for k, v in table.items() if v is not None}
    if not known:
        return F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(literal, F.lower(X.collapse(value)))


def canon(value: Column, name: str, vocabulary: Vocabulary) -> Column:
    if name == "competitor_tier":
        return X.canon_tier(value, list(vocabulary.tiers))
    return lookup(value, *vocabulary.lists(name))


def parts_of(value: Column, name: str) -> Column:
    """The single values of a field; beachhead values are also parted at commas."""
    values = X.split_multi(value)
    return X.split_commas(values) if name == "beachhead" else values


def canonize(value: Column, name: str, vocabulary: Vocabulary) -> Column:
    """The field with all its values canonical and unknown ones dropped; null if none is left."""
    if name == "competitor_tier":
        return F.when(~X.is_missing(value), canon(value, name, vocabulary))
    kept = F.filter(F.transform(parts_of(value, name), lambda v: canon(v, name, vocabulary)), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, X.join_multi(kept, SEPARATORS[name]))


def rejected(value: Column, name: str, vocabulary: Vocabulary) -> Column:
    """What a note should say was dropped: each unknown value; for beachhead and tier the whole cell, only if nothing is left."""
    if name in ("competitor_tier", "beachhead"):
        return F.when(~X.is_missing(value) & canonize(value, name, vocabulary).isNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.filter(parts_of(value, name), lambda v: canon(v, name, vocabulary).isNull())


def drift(df: DataFrame, column: str, known, *, multi: bool = True, top: int = 8, order: str = "row_idx") -> DataFrame:
    """The most frequent values outside a vocabulary: (value, n), ties by first occurrence.

    known: a list of allowed values, or a function from a value's column to its canonical form, null if there is none.
    """
    values = F.explode(X.split_multi(F.col(column))) if multi else F.col(column)
    rows = df.select(F.col(order).alias("o"), values.alias("value")).where(~X.is_blank(F.col("value")))
    outside = known(F.col("value")).isNull() if callable(known) else ~F.col("value").isin(*known)
    rows = rows.where(outside).select("o", X.strip(F.col("value")).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("o").alias("first")).orderBy(F.desc("n"), "first").limit(top).select("value", "n")
