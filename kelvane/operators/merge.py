"""Merging an ingest batch into the master table: plan first, as lazy frames, then apply.

Curated values win: empty fields of a known entity's header row are filled, nothing is overwritten, new details are
appended, unknown entities get new ids. Every frame keeps (entry_idx, record_pos), so nothing depends on row order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelvane.config import FIELDS, MASTER, MIN_CONFIDENCE, PRODUCT_KIND, RowModel
from kelvane.functions import text as X
from kelvane.operators import blocks as B
from kelvane.operators.match import known_entities, match, spread
from kelvane.sources.store import ensure_checkpoint_dir

NEVER_FILLED = ("company_id", "row_kind", "company", "product_name")
# The reasons that results carry.
NO_BLOCK = "Dublette ohne aufloesbaren Block"


@dataclass
class MergePlan:
    """new_rows (append order in append_seq), updates (full rows by row_idx), filled and skipped (in order of seq), decided per entry.

    decided is what the plan needs of the matches: of entries that are no duplicates, matched_company, reason and score are null where they would name
    the most similar entity. ``matches`` has those too. Each frame is built when asked for: thousands of expressions on fields take seconds, which a
    query on one frame needn't wait for; ``matches`` also compares every entry that is no duplicate with all names of its first character.
    """

    master: DataFrame
    records: DataFrame
    decided: DataFrame
    match_all: Callable[[], DataFrame]
    today: str
    min_confidence: float
    model: RowModel
    zero_is_empty: bool
    fold: bool

    @cached_property
    def matches(self) -> DataFrame:
        return self.match_all()

    @cached_property
    def _known(self) -> DataFrame:
        """(entry_idx, company, block_key, b_company, b_id) of duplicates; the block is null where none has the matched name."""
        heads = B.first_rows(self.master, self.model)
        by_name = heads.where("b_company != ''").groupBy(F.lower("b_company").alias("lower_company")).agg(F.max_by(F.struct("block_key", "b_company", "b_id"), "first_idx").alias("b"))
        resolved = self.decided.where("is_duplicate").join(by_name.select("lower_company", "b.*"), F.lower(X.strip(F.col("matched_company"))) == F.col("lower_company"), "left")
        return resolved.select("entry_idx", "company", "block_key", "b_company", "b_id").checkpoint()

    @cached_property
    def _unknown(self) -> DataFrame:
        return self.decided.where("not is_duplicate").select("entry_idx", "company", "confidence")

    @cached_property
    def _keyed(self) -> DataFrame:
        return B.with_blocks(self.master.select("row_idx", *FIELDS), self.model)

    @cached_property
    def _fills(self) -> DataFrame:
        """Header rows of known entities beside the row that they fill, with the state of each field that has a value."""
        target = self._keyed.where("is_header").select("block_key", "row_idx", *[F.col(f).alias(f"t_{f}") for f in FIELDS])
        fills = self._known.where("block_key is not null").drop("company", "b_id").join(self.records.where("record_pos = 0"), "entry_idx").join(target, "block_key")
        fills = spread(fills, "entry_idx").withColumn("sure", F.coalesce("confidence", F.lit(0.0)) >= self.min_confidence)
        state = "CASE WHEN {0} THEN struct({1} AS seq, '{2}' AS field, CASE WHEN NOT {3} THEN 'filled' WHEN NOT sure THEN 'confidence' ELSE 'take' END AS status) END"
        states = [state.format(_given(f), i, f, _blank(f"t_{f}", self.zero_is_empty)) for i, f in enumerate(f for f in FIELDS if f not in NEVER_FILLED)]
        return fills.withColumn("state", F.expr(f"array_compact(array({', '.join(states)}))"))

    @cached_property
    def _cells(self) -> DataFrame:
        return self._fills.select("entry_idx", "b_company", "confidence", F.explode("state").alias("s")).select("entry_idx", "b_company", "confidence", "s.*")

    @cached_property
    def _touched(self) -> DataFrame:
        return self._fills.where("exists(state, s -> s.status = 'take')")

    @cached_property
    def updates(self) -> DataFrame:
        filled = lambda f: f"CASE WHEN {_blank(f't_{f}', self.zero_is_empty)} AND {_given(f)} AND sure THEN `{f}` ELSE `t_{f}` END AS `{f}`"
        value = lambda f: F.lit(self.today).alias(f) if f == "last_update" else F.col(f"t_{f}").alias(f) if f in NEVER_FILLED else F.expr(filled(f))
        rows = self._touched.select("entry_idx", "row_idx", *[value(f) for f in FIELDS])
        if self.fold:
            return rows.groupBy("row_idx").agg(F.max("entry_idx").alias("entry_idx"), *[F.min_by(f, F.when(~X.is_blank(F.col(f)), F.col("entry_idx"))).alias(f) for f in FIELDS])
        return last_writer(rows)

    @cached_property
    def _details(self) -> DataFrame:
        existing = self._keyed.where("not is_header").select("block_key", F.lower(X.strip(X.as_text(F.col(self.model.detail)))).alias("lower_name"))
        details = self._known.where("block_key is not null").drop("company").join(self.records.where("record_pos > 0"), "entry_idx").withColumn("name", X.strip(X.as_text(F.col("product_name")))).where("name != ''")
        return new_details(details, existing, self.min_confidence)

    @cached_property
    def _created(self) -> DataFrame:
        """Records of new entities, with the id of each."""
        first = B.next_id(self.master, self.model)
        fresh = assign_ids(self._unknown.where(F.col("confidence") >= self.min_confidence).crossJoin(first), F.col("next_id")).select("entry_idx", "new_id")
        return self.records.join(fresh, "entry_idx")

    @cached_property
    def new_rows(self) -> DataFrame:
        forced = {"company_id": F.col("b_id"), "company": F.col("b_company"), "row_kind": F.lit(PRODUCT_KIND), "last_update": F.lit(self.today)}
        appended = self._details.where("status = 'accept'").select("entry_idx", "record_pos", *[(forced.get(f, F.col(f))).cast("string").alias(f) for f in FIELDS])
        created = self._created.select("entry_idx", "record_pos", *[(F.col("new_id").cast("string") if f == "company_id" else F.coalesce("last_update", F.lit(self.today)) if f == "last_update" else F.col(f)).alias(f) for f in FIELDS])
        return appended.unionByName(created).withColumn("append_seq", F.row_number().over(W.orderBy("entry_idx", "record_pos")))

    @cached_property
    def _whole_skips(self) -> DataFrame:
        """Entries that the plan skips as they are."""
        lost = self._known.where("block_key is null").select("entry_idx", F.lit(-1).alias("seq"), F.col("company").alias("who"), F.lit(NO_BLOCK).alias("reason"))
        weak = self._unknown.where(F.col("confidence") < self.min_confidence)
        return lost.unionByName(weak.select("entry_idx", F.lit(-1).alias("seq"), F.col("company").alias("who"), F.format_string("Confidence %.2f unter Schwelle", "confidence").alias("reason")))

    @cached_property
    def skipped(self) -> DataFrame:
        base = len(FIELDS)
        fields = self._cells.where("status != 'take'").select("entry_idx", "seq", F.col("b_company").alias("who"), F.when(F.col("status") == "filled", F.concat("field", F.lit(" (bereits gefuellt)"))).otherwise(F.concat("field", F.format_string(" (Confidence %.2f)", F.coalesce("confidence", F.lit(0.0))))).alias("reason"))
        details = self._details.where("status != 'accept'").select("entry_idx", (F.col("record_pos") + base).alias("seq"), F.col("b_company").alias("who"), F.when(F.col("status") == "exists", F.concat(F.lit("Produkt '"), "name", F.lit("' existiert"))).otherwise(F.concat(F.lit("Produkt '"), "name", F.format_string("' (Confidence %.2f)", F.coalesce("confidence", F.lit(0.0))))).alias("reason"))
        return self._whole_skips.unionByName(fields).unionByName(details)

    @cached_property
    def filled(self) -> DataFrame:
        base = len(FIELDS)
        added = self._details.where("status = 'accept'")
        return self._cells.where("status = 'take'").select("entry_idx", "seq", F.col("b_company").alias("company"), F.lit("").alias("product"), "field").unionByName(
            added.select("entry_idx", (F.col("record_pos") + base).alias("seq"), F.col("b_company").alias("company"), F.col("name").alias("product"), F.lit("product_name").alias("field")))

    def summary(self) -> DataFrame:
        """One row of four counts. The states of header rows and of details are read once each, and no row is built to be counted."""
        take = "size(filter(state, s -> s.status = 'take'))"
        heads = self._fills.groupBy("row_idx").agg(F.expr(f"sum({take})").alias("taken"), F.expr(f"sum(size(state) - {take})").alias("left"))
        heads = heads.agg(F.count_if(F.col("taken") > 0).alias("updated"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"), F.coalesce(F.sum("left"), F.lit(0)).alias("left"))
        details = self._details.agg(F.count_if(F.col("status") == "accept").alias("added"), F.count_if(F.col("status") != "accept").alias("known"))
        one = lambda df, n: df.agg(F.count("*").alias(n))
        counts = heads.crossJoin(details).crossJoin(one(self._created, "created")).crossJoin(one(self._whole_skips, "whole"))
        return counts.selectExpr("added + created AS new_rows", "updated AS updated_rows", "taken + added AS filled_fields", "whole + left + known AS skipped")


def _given(field: str) -> str:
    """Not ``X.is_missing``, as SQL text: fields are many, and Column objects take long to build."""
    return f"coalesce(cast(`{field}` AS string) != '', false)"


def _blank(field: str, zero_is_empty: bool) -> str:
    """``X.is_blank`` as SQL text."""
    zero = f" OR coalesce(try_cast(cast(`{field}` AS string) AS double) = 0, false)" if zero_is_empty else ""
    return f"(NOT rlike(coalesce(cast(`{field}` AS string), ''), r'(?U)\\S'){zero})"


def fill_only(target: Column, value: Column, confident: Column, zero_is_empty: bool = False) -> Column:
    """The value where the target is blank and the value may be taken, else the target."""
    return F.when(X.is_blank(target, zero_is_empty) & ~X.is_missing(value) & confident, value).otherwise(target)


def entry_urls(records: DataFrame) -> DataFrame:
    """(entry_idx, url): the last record's address that is not empty."""
    url = X.first_url(F.col("url"))
    return records.groupBy("entry_idx").agg(F.coalesce(F.max_by(F.when(url != "", url), F.when(url != "", F.col("record_pos"))), F.lit("")).alias("url"))


def source_rows(entries: DataFrame, today: str) -> DataFrame:
    """One row per source of every entry, also of those that the plan skips."""
    return entries.select("entry_idx", F.posexplode("sources").alias("source_pos", "source"), "company", "confidence").select("entry_idx", "source_pos", "company", "source", "confidence", F.lit(today).alias("date"))


def last_writer(updates: DataFrame, key: str = "row_idx", order: str = "entry_idx") -> DataFrame:
    """Of the rows of one key the one of the highest order."""
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    return updates.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, F.struct(order)).alias("__r")).select("__r.*")  # partial, and a null order is the lowest


def assign_ids(accepted: DataFrame, first_id: Column, order: str = "entry_idx") -> DataFrame:
    """Adds new_id: first_id and on, in order. The rows are the accepted new entities only."""
    return accepted.withColumn("new_id", (first_id + F.row_number().over(W.orderBy(order)) - 1).cast("long"))


def new_details(details: DataFrame, existing: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Adds status to details (entry_idx, record_pos, block_key, name, confidence): accept, exists or confidence.

    existing: (block_key, lower_name) of a block's detail rows. A detail is accepted if its name is new to the block and to what the entry has
    had accepted before; one of low confidence does not reserve its name.
    """
    rows = details.withColumn("lower_name", F.lower("name"))
    rows = rows.join(existing.select("block_key", "lower_name").distinct().withColumn("there", F.lit(True)), ["block_key", "lower_name"], "left")
    ok = F.col("there").isNull() & (F.col("confidence") >= min_confidence)
    accepted = F.min(F.when(ok, F.col("record_pos"))).over(W.partitionBy("entry_idx", "lower_name"))
    rows = rows.withColumn("__a", accepted)
    return rows.withColumn("status", F.when(F.col("there").isNotNull() | (F.col("record_pos") > F.col("__a")), "exists").when(F.col("record_pos") == F.col("__a"), "accept").otherwise("confidence")).drop("__a", "there", "lower_name")


def plan(master: DataFrame, entries: DataFrame, records: DataFrame, *, today: str, min_confidence: float = MIN_CONFIDENCE, model: RowModel = MASTER, zero_is_empty: bool = True, fold: bool = False) -> MergePlan:
    """entries: (entry_idx, company, confidence, sources); records: (entry_idx, record_pos, confidence, source, fields).

    The index of known entities stays as it was before the batch: the same new entity twice gets two ids. Of two entries that enrich one row
    the later one's update replaces the earlier one's; ``fold`` takes each field from the first entry that fills it instead.
    """
    ensure_checkpoint_dir(master.sparkSession)
    # All four frames start from what the matches decide, which has one row per entry of the batch.
    matched = lambda exact_best: match(entries.join(entry_urls(records), "entry_idx"), known_entities(master, model), key="entry_idx", name="company", exact_best=exact_best)
    settled = F.col("is_duplicate") | (F.col("norm") == "")
    decided = matched(False).withColumns({c: F.when(settled, F.col(c)) for c in ("matched_company", "reason", "score")}).checkpoint()
    return MergePlan(master, records, decided, lambda: matched(True).checkpoint(), today, min_confidence, model, zero_is_empty, fold)


def apply_updates(master: DataFrame, updates: DataFrame, fields=FIELDS, key: str = "row_idx") -> DataFrame:
    """Rows that have an update take all its fields, empty ones as null; others stay."""
    new = updates.select(F.col(key).alias("__k"), F.lit(True).alias("__u"), *[F.col(f).alias(f"u_{f}") for f in fields])
    out = master.join(new, F.col(key) == F.col("__k"), "left")
    return out.select(*[F.when(F.col("__u"), F.when(F.col(f"u_{c}") != "", F.col(f"u_{c}"))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in master.columns])


def append_rows(master: DataFrame, new_rows: DataFrame, fields=FIELDS, entity: str = "company") -> DataFrame:
    """New rows after the last row that names an entity, in append order; empty values as null."""
    last = master.agg(F.coalesce(F.max(F.when(~X.is_blank(F.col(entity)), F.col("row_idx"))), F.lit(-1)).alias("last"))
    rows = new_rows.crossJoin(last).select((F.col("last") + F.col("append_seq")).cast("long").alias("row_idx"), *[F.when(~X.is_missing(F.col(f)), F.col(f)).alias(f) for f in fields])
    return master.unionByName(rows, allowMissingColumns=True)


def apply_plan(master: DataFrame, merge_plan: MergePlan) -> DataFrame:
    return append_rows(apply_updates(master, merge_plan.updates), merge_plan.new_rows)
