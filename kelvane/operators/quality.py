"""Data-quality rules: one projection for all rules of a row, a window for repeated rows, two aggregations for blocks.

Issues are a long frame (seq, severity, code, message, row, company): seq orders them by row, then rule, then block rules by first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelvane.config import FIELDS, MASTER, RowModel
from kelvane.functions import text as X
from kelvane.functions import vocab as V

SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}


def _issue(rule: int, when: Column, severity: str, code: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("part"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))


def _each(rule: int, values: Column, severity: str, code: str, label: str) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(rule).alias("rule"), i.alias("part"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(F.lit(f"{label}: '"), v, F.lit("'")).alias("message")))


def _quoted(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"{label}: '"), X.as_text(c), F.lit("'"))


def duplicate_rows(df: DataFrame, keys: list[Column], exempt: Column, order: str = "row_idx") -> DataFrame:
    """Adds same_as: the row that a row repeats, else null.

    A row's key is stored when it is new; an exempt row stores its own place again and is not reported. So a report names the
    latest earlier row that stored the key.
    """
    named = df.withColumn("__k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).withColumn("__x", F.coalesce(exempt, F.lit(False)))
    w = W.partitionBy("__k").orderBy(order)
    first = F.row_number().over(w) == 1
    named = named.withColumn("__s", F.when(first | F.col("__x"), F.col(order)))
    stored = F.last("__s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return named.withColumn("same_as", F.when(~F.col("__x"), stored)).drop("__k", "__x", "__s")


def row_issues(df: DataFrame, vocabulary: V.Vocabulary, *, strict: bool = False, model: RowModel = MASTER, fields=FIELDS) -> DataFrame:
    """Issues of single rows. df has row_no, the number shown for a row."""
    text = lambda c: X.strip(X.as_text(F.col(c)))
    company, product, kind, url = text(model.entity), text(model.detail), text(model.kind), text(model.url)
    address = X.first_url(F.col(model.url))
    vocab = "error" if strict else "warning"
    broken = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields if f in df.columns]), lambda x: X.has_mojibake(x["v"]))
    tier = F.col(model.tier)
    canonical = V.canon(tier, "competitor_tier", vocabulary)
    is_float = F.col(model.id_is_float) if model.id_is_float in df.columns else F.lit(False)
    has_header, has_detail = kind == model.header_kind, kind == model.detail_kind
    unknown = lambda name: F.filter(V.parts_of(F.col(name), name), lambda v: V.canon(v, name, vocabulary).isNull())
    single = F.array_compact(F.array(
        _issue(2, ~has_header & ~has_detail, "error", "row_kind_invalid", _quoted("row kind", F.col(model.kind))),
        _issue(3, has_header & (product != ""), "warning", "company_row_has_product", _quoted("header row names a product", product)),
        _issue(4, has_detail & (product == ""), "warning", "product_row_no_name", F.lit("detail row without a name")),
        _issue(5, ~X.is_missing(F.col(model.entity_id)) & F.coalesce(is_float, F.lit(False)), "warning", "company_id_not_int", _quoted("id is not a whole number", F.col(model.entity_id))),
        _issue(6, (url != "") & (address == ""), "error", "url_not_a_url", _quoted("no address in the URL field", F.substring(url, 1, 60))),
        _issue(7, (url != "") & (address != "") & (address != F.regexp_replace(url, "/+$", "")), "warning", "url_polluted", _quoted("more than an address in the URL field", F.substring(url, 1, 60))),
        _issue(8, F.size(broken) > 0, "error", "encoding_broken", F.concat(F.lit("broken encoding in '"), F.get(broken, 0)["f"], F.lit("': '"), F.substring(F.get(broken, 0)["v"], 1, 45), F.lit("'"))),
        _issue(9, ~X.is_missing(tier) & canonical.isNull(), "error", "tier_invalid", _quoted("unknown tier", tier)),
        _issue(10, ~X.is_missing(tier) & canonical.isNotNull() & (X.strip(X.as_text(tier)) != canonical), "warning", "tier_non_canonical", _quoted("other spelling of a tier", tier)),
        _issue(14, F.col("same_as").isNotNull(), "warning", "duplicate_row", F.concat(F.lit("identical to row "), F.col("same_as").cast("string"))),
    ))
    many = [_each(r, unknown(c), vocab, code, label) for r, c, code, label in ((11, "key_categories", "key_category_unknown", "unknown key category"), (12, "sub_category", "sub_category_unknown", "unknown sub category"), (13, "beachhead", "beachhead_unknown", "unknown beachhead")) if c in df.columns]
    seen = duplicate_rows(df.where(company != ""), [F.lower(company), F.lower(product), F.lower(address)], (product == "") & ~has_header, "row_no")
    named = seen.select("row_no", company.alias("company"), F.explode(F.concat(single, *many)).alias("i"))
    nameless = df.where(company == "").select("row_no", F.lit("").alias("company"), F.struct(F.lit(1).alias("rule"), F.lit(0).alias("part"), F.lit("error").alias("severity"), F.lit("company_missing").alias("code"), F.lit("no entity name").alias("message")).alias("i"))
    both = named.unionByName(nameless)
    return both.select(F.struct(F.col("row_no").alias("a"), F.col("i.rule").alias("b"), F.col("i.part").alias("c")).alias("seq"), "i.severity", "i.code", "i.message", F.col("row_no").alias("row"), "company")


def block_issues(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """Several header rows of one name, and several names of one id."""
    company, kind = X.strip(X.as_text(F.col(model.entity))), X.strip(X.as_text(F.col(model.kind)))
    rows = df.where(company != "").select("row_no", company.alias("company"), kind.alias("kind"), F.col(model.entity_id).cast("string").alias("id"), F.coalesce(X.whole_number(F.col(model.entity_id)).cast("string"), F.col(model.entity_id).cast("string")).alias("one_id"))
    last = F.lit((1 << 62))
    seq = lambda rule, first: F.struct(last.alias("a"), F.lit(rule).alias("b"), first.cast("int").alias("c")).alias("seq")
    heads = rows.where(F.col("kind") == model.header_kind).groupBy("company").agg(F.count("*").alias("n"), F.min("row_no").alias("first")).where("n > 1")
    heads = heads.select(seq(15, F.col("first")), F.lit("warning").alias("severity"), F.lit("multiple_company_rows").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" header rows of one entity")).alias("message"), F.lit(None).cast("long").alias("row"), "company")
    # Distinct pairs first, so that a set holds an id's names and not its rows.
    pairs = rows.where(~X.is_missing(F.col("id"))).groupBy("one_id", "company").agg(F.min("row_no").alias("first"))
    ids = pairs.groupBy("one_id").agg(F.array_sort(F.collect_set("company")).alias("names"), F.min("first").alias("first")).where(F.size("names") > 1)
    ids = ids.select(seq(16, F.col("first")), F.lit("error").alias("severity"), F.lit("company_id_collision").alias("code"), F.concat(F.lit("id "), "one_id", F.lit(" has "), F.size("names").cast("string"), F.lit(" names: "), F.array_join(F.slice("names", 1, 4), ", ")).alias("message"), F.lit(None).cast("long").alias("row"), F.lit("").alias("company"))
    return heads.unionByName(ids)


def numbered(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """Adds row_no: 2 for the first row, as a sheet with a header shows it. ``row_idx`` counts loaded rows from 0."""
    return df.withColumn("row_no", (F.col(model.row_idx) + 2).cast("long"))


def validate(df: DataFrame, vocabulary: V.Vocabulary, *, strict: bool = False, model: RowModel = MASTER) -> DataFrame:
    """All issues of a table with row_idx; strict: unknown vocabulary is an error."""
    rows = numbered(df, model)
    return row_issues(rows, vocabulary, strict=strict, model=model).unionByName(block_issues(rows, model))


def stats(df: DataFrame, model: RowModel = MASTER) -> DataFrame:
    """rows, entities, header_rows (of named entities), detail_rows (exact kind)."""
    company, kind = X.strip(X.as_text(F.col(model.entity))), X.strip(X.as_text(F.col(model.kind)))
    return df.agg(F.count("*").alias("rows"), F.count_distinct(F.when(company != "", company)).alias("entities"), F.count_if((company != "") & (kind == model.header_kind)).alias("header_rows"), F.count_if(F.coalesce(F.col(model.kind) == model.detail_kind, F.lit(False))).alias("detail_rows"))


def by_code(issues: DataFrame) -> DataFrame:
    """(code, n) by falling count, then first occurrence."""
    return issues.groupBy("code").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").select("code", "n")


def ordered(issues: DataFrame, limit: int = 40) -> DataFrame:
    """The first issues of a report: errors, then warnings, then notes, each in their order."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), F.col("severity")), F.lit(len(SEVERITY_RANK)))
    return issues.orderBy(rank, "seq").limit(limit)


def errors(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'error'")


def warnings(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'warning'")


def render(issues: DataFrame, stat_row: DataFrame, limit: int = 40) -> str:
    """The report as text; only counts and ``limit`` issues reach the driver."""
    lines = ["=" * 72, "VALIDATION REPORT", "=" * 72, *(f"  {k:32s} {v}" for k, v in stat_row.first().asDict().items()), "-" * 72]
    codes = by_code(issues).collect()  # at most one row per rule
    lines += [f"  {r['n']:5d}  {r['code']}" for r in codes] or ["  no issues"]
    lines.append("-" * 72)
    for i in ordered(issues, limit).collect():
        where = f"row {i['row']}" if i["row"] is not None else "block"
        lines.append(f"  [{i['severity']:7s}] {where:9s} {i['code']:24s} {i['company']}: {i['message']}")
    total = issues.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w")).first()
    if total["n"] > limit:
        lines.append(f"  ... and {total['n'] - limit} more")
    return "\n".join([*lines, "=" * 72, f"  {total['e']} errors, {total['w']} warnings, {total['n']} issues"])
