"""Queries over the star-schema tables: each operator bound to columns of those tables, beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelvane.config import RowModel
from kelvane.functions import text as X
from kelvane.functions import vocab as V
from kelvane.functions.similarity import ratio
from kelvane.operators import blocks as B
from kelvane.operators import edits as E
from kelvane.operators import match as J
from kelvane.operators import merge as M
from kelvane.operators import profile as P
from kelvane.operators import quality as Q
from kelvane.sources import store as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SUFFIXES = "|".join(X.LEGAL_SUFFIXES)
VOC = V.Vocabulary(
    key_categories=("AUTOMOBILE", "BUILDING", "MACHINERY"), key_category_aliases={"FURNITURE": "BUILDING", "HOUSEHOLD": None}, sub_categories=("AUTOMOBILE", "BUILDING"),
    tiers=("Tier 1 – Direkt", "Tier 2 – Nachbar", "Tier 3 – Beobachten"), beachhead=("MACHINERY", "BUILDING"),
)
MODEL = RowModel(tier="competitor_tier")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as header rows, their orders as detail rows; row_idx is the place in that order."""
    c = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 1000000000).alias("row_idx"), F.col("c_custkey").cast("string").alias("company_id"), F.col("c_name").alias("company"), F.lit(None).cast("string").alias("product_name"),
        F.lit("Company information").alias("row_kind"), F.col("c_mktsegment").alias("key_categories"), F.lit(None).cast("string").alias("sub_category"), F.lit(None).cast("string").alias("competitor_tier"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("int").cast("string")).alias("revenue"), F.lit(None).cast("string").alias("location"))
    o = read(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(
        (F.col("o_custkey") * 1000000000 + 1 + F.col("o_orderkey")).alias("row_idx"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("company_id"), F.lit("").alias("company"), F.col("o_orderkey").cast("string").alias("product_name"),
        F.lit("Product").alias("row_kind"), F.lit(None).cast("string").alias("key_categories"), F.col("o_orderstatus").alias("sub_category"), F.concat(F.lit("tier "), F.substring("o_orderpriority", 1, 1), F.lit(" - "), F.substring("o_orderpriority", 3, 9)).alias("competitor_tier"),
        F.lit(None).cast("string").alias("revenue"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("N/A (x)")).when(F.col("o_orderkey") % 3 == 1, F.lit("  ")).otherwise(F.lit("here")).alias("location"))
    return c.unionByName(o)


TWO = """WITH t AS (SELECT c_custkey * 1000000000 AS row_idx, c_custkey AS k, true AS h, c_name AS company, NULL AS product_name, c_mktsegment AS key_categories, NULL AS sub_category, NULL AS competitor_tier,
  CASE WHEN c_acctbal >= 0 THEN trunc(c_acctbal)::INT::VARCHAR END AS revenue, NULL AS location FROM customer
UNION ALL SELECT o_custkey * 1000000000 + 1 + o_orderkey, o_custkey, false, '', o_orderkey::VARCHAR, NULL, o_orderstatus, 'tier ' || o_orderpriority[1:1] || ' - ' || o_orderpriority[3:11], NULL,
  CASE o_orderkey % 3 WHEN 0 THEN 'N/A (x)' WHEN 1 THEN '  ' ELSE 'here' END FROM orders WHERE o_orderstatus <> 'P') """


@query(TWO + "SELECT 'id:' || k AS block_key, min(row_idx) AS first_idx, bool_or(h) AS has_header, count(*) FILTER (NOT h) AS n_details, count(*) FILTER (NOT h AND trim(coalesce(product_name, '')) <> '') AS n_named_details FROM t GROUP BY k")
def q_blocks(spark, d):
    return B.block_stats(two_level(spark, d), MODEL)


@query(TWO + "SELECT 'id:' || k AS block_key, max(company) FILTER (h) AS company, count(*) FILTER (NOT h) AS n_products, min(row_idx) AS first_row, max(row_idx) AS last_row FROM t GROUP BY k")
def q_block_rows(spark, d):
    b = B.blocks(two_level(spark, d), MODEL, ["row_idx", "company", "product_name"])
    return b.select("block_key", F.col("company_row.company").alias("company"), F.size("product_rows").cast("long").alias("n_products"), F.element_at("row_indices", 1).alias("first_row"), F.element_at("row_indices", -1).alias("last_row"))


@query(TWO + "SELECT count(*) AS rows, count(DISTINCT k) AS blocks, count(*) FILTER (NOT h) AS detail_rows, count(*) FILTER (h) AS blocks_with_header, count(DISTINCT k) FILTER (NOT h) AS blocks_with_details FROM t")
def q_kpi(spark, d):
    return P.kpis(two_level(spark, d), MODEL)


@query(TWO + "SELECT trim(competitor_tier) AS tier, count(*) AS n FROM t WHERE trim(competitor_tier) <> '' GROUP BY 1")
def q_tier_hist(spark, d):
    return P.tier_histogram(two_level(spark, d))


FILL = ", ".join(f"('{f}', {f})" for f in ("company", "product_name", "revenue", "location"))


@query(TWO + f"SELECT f AS field, count(*) FILTER (trim(coalesce(v, '')) <> '' AND NOT starts_with(lower(trim(v)), 'n/a')) AS filled, count(*) AS total FROM t, LATERAL (VALUES {FILL}) x(f, v) GROUP BY f")
def q_fill_true(spark, d):
    return P.fill_rates(two_level(spark, d), ["company", "product_name", "revenue", "location"]).drop("pct")


@query(TWO + f"SELECT f AS field, count(*) FILTER (trim(coalesce(v, '')) <> '') AS filled, count(*) AS total FROM t, LATERAL (VALUES {FILL}) x(f, v) GROUP BY f")
def q_fill_naive(spark, d):
    return P.fill_rates(two_level(spark, d), ["company", "product_name", "revenue", "location"], policy="blank").drop("pct")


@query(TWO + """SELECT 'id:' || k AS block_key, array_to_string(list_filter([CASE WHEN NOT bool_or(NOT h) THEN 'product_name' END, CASE WHEN coalesce(max(revenue) FILTER (h), '') = '' THEN 'revenue' END,
  CASE WHEN NOT bool_or(trim(coalesce(sub_category, '')) <> '') THEN 'sub_category' END, CASE WHEN coalesce(max(location) FILTER (h), '') = '' THEN 'location' END], lambda x: x IS NOT NULL), ',') AS missing FROM t GROUP BY k""")
def q_missing_fields(spark, d):
    return B.missing_fields(two_level(spark, d), ["product_name", "revenue", "sub_category", "location"], MODEL).withColumn("missing", F.array_join("missing", ","))


@query("SELECT coalesce(max(greatest(c_custkey, 0)), 0) + 1 AS next_id FROM customer")
def q_next_id(spark, d):
    return B.next_id(two_level(spark, d), MODEL)


def dirty_pages(spark, d):
    p = read(spark, d, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"\.example\.\w+", ".example.co.uk")).otherwise(F.col("url"))
    return p.select("page_id", F.when(F.col("page_id") % 7 == 0, F.lit("Page title | x")).otherwise(F.concat(url, F.lit("/ | Berlin, Germany"))).alias("raw"))


DIRTY = r"WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Page title | x' ELSE (CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '\.example\.\w+', '.example.co.uk') ELSE url END) || '/ | Berlin, Germany' END AS raw FROM pages), u AS (SELECT page_id, regexp_replace(regexp_extract(raw, '(?i)https?://[^\s|,;]+'), '[/.,;|]+$', '') AS url FROM p) "


@query(DIRTY + "SELECT page_id, url FROM u")
def q_first_url(spark, d):
    return dirty_pages(spark, d).select("page_id", X.first_url(F.col("raw")).alias("url"))


@query(DIRTY + r", h AS (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\.', ''), '.') AS l FROM u) SELECT page_id, CASE WHEN len(l) < 2 THEN '' WHEN len(l) >= 3 AND l[-2] || '.' || l[-1] = 'co.uk' THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h")
def q_domain(spark, d):
    return dirty_pages(spark, d).select("page_id", X.registrable_domain(F.col("raw")).alias("domain"))


@query(r"""WITH n AS (SELECT 's' AS kind, s_suppkey AS id, s_name || ' GmbH' AS name FROM supplier UNION ALL SELECT 'c', c_custkey, 'The ' || c_name || ', Inc.' FROM customer),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(name), '[–—_/,]', ' ', 'g'), '[^a-z0-9\s&+.-]', ' ', 'g'), '[\s.]+'), lambda x: x <> '') AS w FROM n)
SELECT kind, id, array_to_string(list_filter(string_split(regexp_replace(array_to_string(w, ' '), '((^| )[&+-]*(""" + SUFFIXES + r""")[&+-]*)+$', ''), ' '), lambda x: x <> 'the' AND x <> ''), ' ') AS norm FROM w""")
def q_norm_name(spark, d):
    s = read(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" GmbH")).alias("name"))
    c = read(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit("The "), "c_name", F.lit(", Inc.")).alias("name"))
    return s.unionByName(c).select("kind", "id", X.normalize_company(F.col("name")).alias("norm"))


@query("SELECT o_orderkey, o_custkey, CASE 1 + o_orderkey % 5 WHEN 1 THEN 'Tier 1 – Direkt' WHEN 2 THEN 'Tier 2 – Nachbar' WHEN 3 THEN 'Tier 3 – Beobachten' END AS tier FROM orders")
def q_canon_tier(spark, d):
    raw = F.concat(F.lit(" tier "), (1 + F.col("o_orderkey") % 5).cast("string"), F.lit(" - x"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", X.canon_tier(raw, list(VOC.tiers)).alias("tier"))


VALUES = "v(lower_key, canonical, p) AS (VALUES ('automobile', 'AUTOMOBILE', 0), ('building', 'BUILDING', 1), ('machinery', 'MACHINERY', 2), ('furniture', 'BUILDING', 3), ('household', NULL, 4))"


@query(f"WITH {VALUES} SELECT c_custkey, v.canonical AS segment FROM customer LEFT JOIN v ON lower(c_mktsegment) = lower_key")
def q_canon_vocab(spark, d):
    return read(spark, d, "customer").select("c_custkey", V.canon(F.concat(F.lit(" "), F.lower("c_mktsegment")), "key_categories", VOC).alias("segment"))


@query(f"WITH {VALUES} SELECT c_custkey, v.canonical AS segment FROM customer LEFT JOIN v ON lower(c_mktsegment) = lower_key")
def q_vocab_join(spark, d):
    terms = VOC.terms(spark).where("domain = 'key_categories'")
    first = terms.groupBy("lower_key").agg(F.min_by("canonical", "priority").alias("segment"))
    return read(spark, d, "customer").withColumn("lower_key", F.lower(X.collapse(F.col("c_mktsegment")))).join(first, "lower_key", "left").select("c_custkey", "segment")


@query("SELECT p_partkey, array_to_string(list_distinct_keep, '; ') AS joined, len(parts) AS n FROM (SELECT p_partkey, [p_name, p_type, p_brand, p_name] AS parts, list_filter([p_name, p_type, p_brand], lambda x: true) AS list_distinct_keep FROM part)")
def q_split_join(spark, d):
    raw = F.concat_ws(" | ", F.col("p_name"), F.concat(F.col("p_type"), F.lit(" ; "), F.col("p_brand")), F.lit("  "), F.col("p_name"))
    values = X.split_multi(raw)
    return read(spark, d, "part").select("p_partkey", X.join_multi(values).alias("joined"), F.size(values).cast("long").alias("n"))


@query("SELECT p_type AS value, count(*) AS n FROM part WHERE p_type NOT IN (SELECT min(p_type) FROM part) GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 3")
def q_vocab_drift(spark, d):
    part = read(spark, d, "part")
    known = part.agg(F.min("p_type")).first()[0]
    return V.drift(part, "p_type", [known], multi=False, top=3, order="p_partkey")


@query(r"WITH u AS (SELECT page_id, array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.') AS domain, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), i AS (SELECT domain, arg_min(host, page_id) AS host, min(page_id) AS first_page FROM u GROUP BY domain) SELECT u.page_id, u.domain, i.host AS matched FROM u JOIN i USING (domain)")
def q_match_domain(spark, d):
    p = read(spark, d, "pages").withColumn("domain", X.registrable_domain(F.col("url"))).withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    index = p.groupBy("domain").agg(F.min_by("host", "page_id").alias("matched"))
    return p.select("page_id", "domain").join(index, "domain").select("page_id", "domain", "matched")


@query("WITH k AS (SELECT lower(p_name) AS norm, arg_min(p_name, p_partkey) AS matched FROM part GROUP BY 1) SELECT p_partkey, k.matched FROM part LEFT JOIN k ON lower(p_name) = norm")
def q_match_name(spark, d):
    part = read(spark, d, "part")
    known = part.select(F.struct(F.lit(0), "p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit("").alias("url"))
    cand = part.select("p_partkey", X.normalize_company(F.concat("p_name", F.lit(" GmbH"))).alias("norm"))
    return cand.join(J.name_index(known), "norm", "left").select("p_partkey", F.col("n_name").alias("matched"))


@query()
def q_match_fuzzy(spark, d):
    s = read(spark, d, "supplier")
    known = s.select(F.struct(F.lit(0), "s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.lit("").alias("url"))
    typo = F.concat(F.substring("s_name", 1, 4), F.expr("substring(s_name, 6)"), F.lit(" AG"))
    return J.match(s.select(F.col("s_suppkey").alias("cand_idx"), typo.alias("name"), F.lit("").alias("url")), known).select("cand_idx", "is_duplicate", "matched_company", "score")


@query()
def q_similarity(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_type").distinct()
    return p.select("p_brand", "p_type", ratio("p_brand", "p_type").alias("score"))


@query("SELECT doc_id AS cand_idx, coalesce(text, '') = '' OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_fresh, CASE WHEN coalesce(text, '') <> '' AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN '(innerhalb dieses Laufs)' END AS duplicate_of FROM documents")
def q_batch_partition(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("cand_idx"), F.lit("").alias("domain"), F.coalesce("text", F.lit("")).alias("norm"), F.lit(False).alias("is_duplicate"), F.lit("").alias("matched_company"), F.lit("").alias("reason"))
    return J.partition(docs).select("cand_idx", "is_fresh", "duplicate_of")


@query("SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN d.lang WHEN d.source <> 'src1' THEN l.quality::VARCHAR END AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_fill_only_merge(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", F.col("lang")).alias("target"))
    new = read(spark, d, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("string").alias("new"))
    return docs.join(new, F.col("doc_id") == F.col("k"), "left").select("doc_id", M.fill_only(F.col("target"), F.col("new"), F.col("source") != "src1").alias("value"))


@query("""WITH x AS (SELECT l_orderkey AS entry, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS pos, l_suppkey, l_discount FROM lineitem),
s AS (SELECT entry, pos, 'S' || l_suppkey AS name, l_discount, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 6) AS there FROM x), a AS (SELECT *, min(pos) FILTER (NOT there AND l_discount >= 0.03) OVER (PARTITION BY entry, name) AS acc FROM s)
SELECT CASE WHEN there OR pos > acc THEN 'exists' WHEN pos = acc THEN 'accept' ELSE 'confidence' END AS status, count(*) AS n, sum(entry)::BIGINT AS entries FROM a GROUP BY 1""")
def q_new_products(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rows = read(spark, d, "lineitem").withColumn("record_pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
    rows = rows.select(F.col("l_orderkey").alias("entry_idx"), "record_pos", F.lit("b").alias("block_key"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_discount").alias("confidence"))
    there = read(spark, d, "supplier").where("s_nationkey < 6").select(F.lit("b").alias("block_key"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("lower_name"))
    return M.new_details(rows, there, 0.03).groupBy("status").agg(F.count("*").alias("n"), F.sum("entry_idx").alias("entries"))


@query("SELECT c_custkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey) AS new_id FROM customer WHERE c_acctbal > 9000")
def q_assign_ids(spark, d):
    c = read(spark, d, "customer")
    top = c.agg((F.max("c_custkey") + 1).alias("next_id"))
    return M.assign_ids(c.where("c_acctbal > 9000").select("c_custkey").crossJoin(top), F.col("next_id"), "c_custkey").select("c_custkey", "new_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_lww_updates(spark, d):
    return M.last_writer(read(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


@query("SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'X' WHEN '2-HIGH' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def q_edit_overwrite(spark, d):
    orders = read(spark, d, "orders").withColumnRenamed("o_orderkey", "row_idx")
    o = orders.select("row_idx", "o_custkey", "o_orderstatus")
    basket = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("row_idx", F.lit("o_orderstatus").alias("field"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise("").alias("new_value"))
    return E.apply_edits(o, basket, fields=("o_orderstatus",)).withColumnRenamed("row_idx", "o_orderkey")


@query("SELECT o_orderkey AS row_idx, 'o_orderstatus' AS field, o_orderstatus AS old_value, 'F' AS new_value FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def q_edit_diff(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_orderstatus", "o_orderpriority", F.lit("o").alias("company"))
    basket = E.stage(o, o.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("F")), fields=("o_orderstatus",))
    return E.differences(o, basket, ("o_orderstatus",), ("company",)).drop("who")


def defective(spark, d):
    """Customers with seeded defects, as a table of the contract's columns that rules look at."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        k.alias("row_idx"), (k % 3 == 0).alias("company_id_is_float"), (k % 500).cast("string").alias("company_id"), F.when(k % 11 == 0, " ").otherwise(F.col("c_name")).alias("company"), F.when(k % 2 == 0, "p").alias("product_name"),
        F.when(k % 5 == 0, "odd").when(k % 3 == 0, "Product").otherwise("Company information").alias("row_kind"), F.concat("c_mktsegment", F.lit(" | MACHINERY")).alias("key_categories"), F.col("c_mktsegment").alias("sub_category"),
        F.concat(F.lit("MACHINERY, "), "c_mktsegment").alias("beachhead"), F.when(k % 4 == 0, "https://a.example/").when(k % 4 == 1, "https://a.example | b").when(k % 4 == 2, "title").alias("url"),
        F.when(k % 6 == 0, "Tier 1 – Direkt").when(k % 6 == 1, "tier 2").when(k % 6 == 2, "none").alias("competitor_tier"), F.when(k % 9 == 0, "kaputt Ã¶").alias("remarks"))


ISSUES = """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, CASE WHEN c_custkey % 5 = 0 THEN 'odd' WHEN c_custkey % 3 = 0 THEN 'd' ELSE 'h' END AS kind, c_name FROM customer), n AS (SELECT * FROM c WHERE k % 11 <> 0),
i(code, severity, k) AS (SELECT 'company_missing', 'error', k FROM c WHERE k % 11 = 0 UNION ALL SELECT 'row_kind_invalid', 'error', k FROM n WHERE kind = 'odd' UNION ALL SELECT 'company_row_has_product', 'warning', k FROM n WHERE kind = 'h' AND k % 2 = 0
UNION ALL SELECT 'product_row_no_name', 'warning', k FROM n WHERE kind = 'd' AND k % 2 = 1 UNION ALL SELECT 'company_id_not_int', 'warning', k FROM n WHERE k % 3 = 0 UNION ALL SELECT 'url_not_a_url', 'error', k FROM n WHERE k % 4 = 2
UNION ALL SELECT 'url_polluted', 'warning', k FROM n WHERE k % 4 = 1 UNION ALL SELECT 'encoding_broken', 'error', k FROM n WHERE k % 9 = 0 UNION ALL SELECT 'tier_invalid', 'error', k FROM n WHERE k % 6 = 2 UNION ALL SELECT 'tier_non_canonical', 'warning', k FROM n WHERE k % 6 = 1
UNION ALL SELECT 'key_category_unknown', 'warning', k FROM n WHERE s = 'HOUSEHOLD' UNION ALL SELECT 'sub_category_unknown', 'warning', k FROM n WHERE s NOT IN ('AUTOMOBILE', 'BUILDING') UNION ALL SELECT 'beachhead_unknown', 'warning', k FROM n WHERE s NOT IN ('MACHINERY', 'BUILDING')
UNION ALL SELECT 'company_id_collision', 'error', NULL FROM (SELECT k % 500 AS g FROM n GROUP BY 1 HAVING count(DISTINCT c_name) > 1)) """


@query(ISSUES + "SELECT code, severity, coalesce(k + 2, 0) AS row FROM i")
def q_rules_row(spark, d):
    return Q.validate(defective(spark, d), VOC).select("code", "severity", F.coalesce("row", F.lit(0)).alias("row"))


@query(ISSUES + "SELECT code, count(*) AS n FROM i GROUP BY 1")
def q_issue_report(spark, d):
    return Q.by_code(Q.validate(defective(spark, d), VOC))


@query(ISSUES + "SELECT count(*) AS n FROM i WHERE severity = 'error'")
def q_strict_gate(spark, d):
    return Q.errors(Q.validate(defective(spark, d), VOC)).agg(F.count("*").alias("n"))


@query(ISSUES + "SELECT count(*) AS rows, count(DISTINCT c_name) FILTER (k % 11 <> 0) AS entities, count(*) FILTER (k % 11 <> 0 AND kind = 'h') AS header_rows, count(*) FILTER (kind = 'd') AS detail_rows FROM c")
def q_validate_stats(spark, d):
    return Q.stats(defective(spark, d))


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS i FROM lineitem"


@query(f"WITH r AS ({NUMBERED}), s AS (SELECT *, l_returnflag = 'R' AS x, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY i)), t AS (SELECT *, last_value(CASE WHEN n = 1 OR x THEN i END IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM s) SELECT l_orderkey, i, st AS same_as FROM t WHERE NOT x AND st IS NOT NULL")
def q_rules_dup(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rows = read(spark, d, "lineitem").withColumn("i", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    return Q.duplicate_rows(rows, [F.col("l_orderkey"), F.col("l_linenumber")], F.col("l_returnflag") == "R", "i").where("same_as is not null").select("l_orderkey", "i", "same_as")


@query("WITH n AS (SELECT p_brand, count(DISTINCT p_name) AS names FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1) SELECT 'company_id_collision' AS code, names AS n FROM n UNION ALL SELECT 'multiple_company_rows', count(*) FROM part GROUP BY p_name HAVING count(*) > 1")
def q_rules_block(spark, d):
    rows = read(spark, d, "part").select((F.col("p_partkey") + 2).alias("row_no"), F.col("p_name").alias("company"), F.lit("Company information").alias("row_kind"), F.col("p_brand").alias("company_id"))
    return Q.block_issues(rows).select("code", F.coalesce(F.regexp_extract("message", r"has (\d+) names", 1).try_cast("long"), F.regexp_extract("message", r"^(\d+) header", 1).try_cast("long")).alias("n"))


@query(TWO + "SELECT b.company, b.n_details, '' AS tier FROM (SELECT max(company) FILTER (h) AS company, count(*) FILTER (NOT h) AS n_details FROM t GROUP BY k) b WHERE contains(lower(b.company), '00001')")
def q_search(spark, d):
    return P.search(two_level(spark, d), "00001", "", MODEL)


@query(TWO + "SELECT 'id:' || k AS block_key, max(company) FILTER (h) AS company, count(*) FILTER (NOT h) AS n_details FROM t GROUP BY k ORDER BY n_details DESC, min(row_idx) LIMIT 10")
def q_top_entities(spark, d):
    return P.top_entities(two_level(spark, d), 10, MODEL)


NAMES = [("out/M_v2.2.xlsx", 0), ("data/M_v2.10.xlsx", 1), ("root/M_v2.10.xlsx", 2), ("out/M_v2.9.xlsx", 0), ("out/M_v3.xlsx", 0)]


@query("WITH n(path, pr) AS (VALUES " + ", ".join(f"('{p}', {i})" for p, i in NAMES) + r") SELECT path FROM n WHERE regexp_matches(path, '_v\d+\.\d+\.xlsx$') ORDER BY regexp_extract(path, '_v(\d+)\.(\d+)', 1)::INT DESC, regexp_extract(path, '_v(\d+)\.(\d+)', 2)::INT DESC, pr LIMIT 1")
def q_latest_version(spark, d):
    return S.latest_name(spark.createDataFrame(NAMES, "path string, priority int"))


@query("WITH n(path, pr) AS (VALUES " + ", ".join(f"('{p}', {i})" for p, i in NAMES) + r") SELECT path, CASE WHEN regexp_matches(path, '_v\d+\.\d+\.xlsx$') THEN regexp_replace(path, '\d+\.xlsx$', '') || (regexp_extract(path, '(\d+)\.xlsx$', 1)::INT + 1)::VARCHAR || '.xlsx' ELSE replace(path, '.xlsx', '_enriched_260101.xlsx') END AS bumped FROM n")
def q_bump(spark, d):
    return spark.createDataFrame(NAMES, "path string, priority int").select("path", S.bumped(F.col("path"), None, "260101").alias("bumped"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, length(text) AS n FROM conversations")
def q_json_batch(spark, d):
    turns = read(spark, d, "conversations")
    doc = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("j"))
    back = doc.select("conv_id", F.posexplode(F.from_json("j", "array<struct<turn:long,role:string,text:string>>")).alias("pos", "x"))
    return back.select("conv_id", F.col("pos").cast("long").alias("pos"), "x.role", F.length("x.text").cast("long").alias("n"))


@query("SELECT event_type, source, count(*) AS n FROM (SELECT event_type, unnest(string_split(event_type || ',' || (event_id % 3)::VARCHAR, ',')) AS source FROM events) GROUP BY ALL")
def q_source_fanout(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("entry_idx"), F.col("event_type").alias("company"), F.lit(1.0).alias("confidence"), F.array("event_type", (F.col("event_id") % 3).cast("string")).alias("sources"))
    return M.source_rows(e, "2026-01-01").groupBy(F.col("company").alias("event_type"), "source").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM customer) AS before, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS added, (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS after")
def q_row_balance(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("company"))
    new = c.join(read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("row_idx")), "row_idx").withColumn("append_seq", F.row_number().over(W.orderBy("row_idx")))
    after = M.append_rows(c, new, ["company"])
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(c, "before").crossJoin(one(new, "added")).crossJoin(one(after, "after"))


def _all() -> None:
    from kelvane.plans import catalog_master  # noqa: F401  it registers its queries here


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
