"""Ingest batches: one JSON document with entities, their header values and their details, as flat frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.config import COMPANY_KIND, FIELDS, PRODUCT_KIND, VOCABULARY_FIELDS, IngestError
from kelvane.functions import text as X
from kelvane.functions import vocab as V

SCHEMA = "companies array<struct<company: string, confidence: double, sources: array<string>, company_row: map<string,string>, products: array<map<string,string>>>>, run map<string,string>"


@dataclass
class Batch:
    """entries (entry_idx, company, confidence, sources); records (entry_idx, record_pos, confidence, source, fields); notes (entry_idx, seq, company, note)."""

    entries: DataFrame
    records: DataFrame
    notes: DataFrame


def read_batch(spark: SparkSession, path: str, vocabulary: V.Vocabulary, *, today: str) -> Batch:
    """Raises IngestError for what breaks the contract: no JSON, no entities, an entity without a name."""
    raw = spark.read.schema(f"{SCHEMA}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    state = raw.select(F.col("_bad").isNotNull().alias("bad"), F.coalesce(F.size("companies"), F.lit(0)).alias("n"), F.exists("companies", lambda c: X.is_blank(c["company"])).alias("nameless")).collect()  # a row per document
    if not state or any(r["bad"] for r in state):
        raise IngestError("the batch is not valid JSON")
    if any(r["n"] <= 0 for r in state):
        raise IngestError("'companies' is missing or empty")
    if any(r["nameless"] for r in state):
        raise IngestError("an entity has no name")
    return flatten(raw, vocabulary, today=today)


def flatten(raw: DataFrame, vocabulary: V.Vocabulary, *, today: str) -> Batch:
    one = raw.select(F.posexplode("companies").alias("entry_idx", "c"))
    base = one.select(
        "entry_idx", X.strip(F.col("c.company")).alias("company"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"),
        F.filter(F.coalesce("c.sources", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")).alias("sources"),
        F.coalesce("c.company_row", F.create_map().cast("map<string,string>")).alias("company_row"), F.coalesce("c.products", F.array().cast("array<map<string,string>>")).alias("products"),
    )
    named = lambda p: ~X.is_blank(F.try_element_at(p, F.lit("product_name")))
    payloads = F.concat(F.array("company_row"), F.filter("products", named))
    flat = base.select("entry_idx", "company", "confidence", "sources", F.posexplode(payloads).alias("record_pos", "p"))
    given = lambda f: F.try_element_at("p", F.lit(f))
    header = F.col("record_pos") == 0

    def value(f: str):
        if f == "company":
            return F.col("company")
        if f == "row_kind":
            return F.when(header, COMPANY_KIND).otherwise(PRODUCT_KIND)
        out = X.clean(given(f))
        out = V.canonize(out, f, vocabulary) if f in VOCABULARY_FIELDS else out
        if f == "last_update":
            return F.coalesce(out, F.lit(today))
        return F.when(~header, out) if f == "product_name" else out

    own = F.when(header, F.col("confidence")).otherwise(F.coalesce(given("confidence").try_cast("double"), "confidence"))
    records = flat.select("entry_idx", "record_pos", own.alias("confidence"), F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("source"), *[value(f).alias(f"v_{f}") for f in FIELDS])
    records = records.select("entry_idx", "record_pos", "confidence", "source", *[F.col(f"v_{f}").alias(f) for f in FIELDS])
    strange = F.filter(F.map_keys("p"), lambda k: ~k.isin(*FIELDS))
    unknown = flat.select("entry_idx", F.struct("record_pos", F.lit(0)).alias("seq"), "company", F.explode(F.transform(strange, lambda k: F.concat(F.lit("unbekanntes Feld '"), k, F.lit("' ignoriert")))).alias("note"))
    dropped = [flat.select("entry_idx", F.struct("record_pos", F.lit(i + 1)).alias("seq"), "company", F.explode(F.transform(V.rejected(X.clean(given(f)), f, vocabulary), lambda v: F.concat(F.lit(f"{f} '"), v, F.lit("' unbekannt - verworfen")))).alias("note")) for i, f in enumerate(VOCABULARY_FIELDS)]
    nameless = base.select("entry_idx", F.struct(F.lit(1 << 30), F.lit(0)).alias("seq"), "company", F.explode(F.transform(F.filter("products", lambda p: ~named(p)), lambda p: F.lit("Produkt ohne product_name uebersprungen"))).alias("note"))
    notes = unknown
    for n in (*dropped, nameless):
        notes = notes.unionByName(n.select("entry_idx", F.col("seq").cast(notes.schema["seq"].dataType).alias("seq"), "company", "note"))
    return Batch(base.select("entry_idx", "company", "confidence", "sources"), records, notes)
