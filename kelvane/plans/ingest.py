"""The write path: scan, strict gate, plan, apply, row-balance gate, artifacts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.config import MIN_CONFIDENCE
from kelvane.functions.vocab import DEFAULT, Vocabulary
from kelvane.operators import edits as E
from kelvane.operators import merge as M
from kelvane.operators import quality as Q
from kelvane.sources import batch as S
from kelvane.sources.store import VersionStore, write_csv, write_text
from kelvane.sources.workbook import WorkbookStore


@dataclass
class Outcome:
    """code 0: done or nothing to do; 2: errors in the batch."""

    code: int
    version: str | None = None
    report: str = ""
    plan: M.MergePlan | None = None


def ingest(spark: SparkSession, store: VersionStore | WorkbookStore, path: str, *, out_dir: str | None = None, stamp: str = "", today: str, vocabulary: Vocabulary | None = None, version: str | None = None, min_confidence: float = MIN_CONFIDENCE, dry_run: bool = False, fold: bool = False) -> Outcome:
    """Cached frames are released at the end; a plan in the outcome reads its inputs again when asked."""
    held = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.cache())
        return held[-1]

    try:
        vocabulary = vocabulary or Vocabulary.load()
        master = store.read()
        batch = S.read_batch(spark, path, vocabulary, today=today)
        records = hold(batch.records)
        checked = records.withColumn("row_idx", F.row_number().over(M.W.orderBy("entry_idx", "record_pos")).cast("long") - 1).withColumn("company_id_is_float", F.lit(False))
        issues = hold(Q.validate(checked, vocabulary, strict=True))
        if not Q.errors(issues).isEmpty():
            return Outcome(2, report=Q.render(issues, Q.stats(checked)))
        plan = M.plan(master, batch.entries, records, today=today, min_confidence=min_confidence, fold=fold)
        plan.new_rows, plan.updates, plan.skipped, plan.filled = hold(plan.new_rows), hold(plan.updates), hold(plan.skipped), hold(plan.filled)
        n_new, n_up = plan.new_rows.count(), plan.updates.count()
        if dry_run or not (n_new or n_up):
            return Outcome(0, plan=plan)
        if isinstance(store, WorkbookStore):
            written = store.write_plan(plan.updates, plan.new_rows, version)
        else:
            written = store.write(M.apply_plan(master, plan), version, expected=master.count() + n_new)
        report = _report(plan, batch, path, written, n_new)
        if out_dir:
            run = f"{out_dir}/run_{stamp}"
            write_csv(plan.new_rows.drop("append_seq", "entry_idx", "record_pos"), f"{run}/new_rows.csv")
            write_csv(M.source_rows(batch.entries, today).select("company", "source", "confidence", "date"), f"{run}/sources.csv")
            write_text(spark, f"{run}/report.md", report)
            first = lambda df, *cols: [list(r) for r in df.orderBy("entry_idx", "seq").select(*cols).limit(500).collect()]
            write_text(spark, f"{run}/plan.json", json.dumps({"new_rows": n_new, "updated_rows": n_up, "filled_fields": first(plan.filled, "company", "product", "field"), "skipped": first(plan.skipped, "who", "reason")}, ensure_ascii=False, indent=2))
        return Outcome(0, written, report, plan)
    finally:
        for df in held:
            df.unpersist()


def _report(plan: M.MergePlan, batch: S.Batch, path: str, version: str, n_new: int, limit: int = 50) -> str:
    """Counts of everything, and the first ``limit`` lines of each list."""
    matches = plan.decided.where("is_duplicate").orderBy("entry_idx").select("company", "matched_company", "reason")
    enriched = [f"  - {r[0]} -> {r[1]} ({r[2]})" for r in matches.limit(limit).collect()]
    created = plan.new_rows.where("record_pos = 0")
    new = [r[0] for r in created.orderBy("append_seq").select("company").limit(limit).collect()]
    skipped = [f"  - {r[0]}: {r[1]}" for r in plan.skipped.orderBy("entry_idx", "seq").select("who", "reason").limit(limit).collect()]
    notes = [f"  - {r[0]}: {r[1]}" for r in batch.notes.orderBy("entry_idx", "seq").select("company", "note").limit(limit).collect()]
    return "\n".join(["# Ingest report", "", f"- batch: `{path}`", f"- version: `{version}` (+{n_new} rows)", f"- new entities: {created.count()}", *[f"  - {n}" for n in new], f"- enriched: {matches.count()}", *enriched, f"- skipped: {plan.skipped.count()}", *skipped, f"- notes: {batch.notes.count()}", *notes])


def apply_basket(store: VersionStore, basket, *, today: str) -> str:
    """Writes a new version with the staged edits; ConflictError if they were staged on another version."""
    current = store.latest()
    for r in basket.select("version").distinct().limit(2).collect():
        E.check_base(r["version"], current)
    master = store.read(current)
    return store.write(E.apply_edits(master, basket.drop("version"), today=today), expected=master.count())


def health(spark: SparkSession, store: VersionStore | None = None) -> dict:
    """What an operator wants to know first: vocabulary, versions, optional libraries."""
    import importlib.util

    return {"vocabulary": Path(DEFAULT).exists(), **({"latest": store.latest()} if store else {}), "spark": spark.version, **{m: importlib.util.find_spec(m) is not None for m in ("yaml", "pandas", "pyarrow")}}
