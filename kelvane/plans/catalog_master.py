"""More queries: operators that read, match, plan and report, each called on columns of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelvane.config import COLUMNS, FIELDS, RowModel
from kelvane.functions import text as X
from kelvane.functions import vocab as V
from kelvane.functions.similarity import ratio, with_domain_fit
from kelvane.operators import blocks as B
from kelvane.operators import edits as E
from kelvane.operators import match as J
from kelvane.operators import merge as M
from kelvane.operators import profile as P
from kelvane.operators import quality as Q
from kelvane.plans.catalog import FILL, ISSUES, NUMBERED, TWO, VOC, defective, query, read, two_level
from kelvane.sources.batch import flatten
from kelvane.sources.headers import bind

TODAY = "2026-01-02"


def nothing():
    return F.lit(None).cast("string")


@query("""WITH u AS (SELECT page_id, array_to_string(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')[-2:], '.') AS domain FROM pages),
i AS (SELECT domain, min(page_id) AS first FROM u WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, domain, 'Example ' || first || ' GmbH' AS matched FROM u JOIN i USING (domain)""")
def q_domain_index(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Example "), F.col("page_id").cast("string"), F.lit(" GmbH "))).otherwise("Otherwise")
    known = p.select(F.struct(F.lit(0), "page_id").alias("pos"), name.alias("name"), "url")
    return p.withColumn("domain", X.registrable_domain(F.col("url"))).join(J.domain_index(known), "domain").select("page_id", "domain", F.col("d_name").alias("matched"))


@query("SELECT page_id, page_id % 7 <> 0 AND page_id % 5 < 3 AS fits FROM pages")
def q_domain_fit(spark, d):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, "Example AG").when(k % 5 == 1, "Exam").when(k % 5 == 2, "Exampel, Inc.").when(k % 5 == 3, "Other Things").otherwise("Exa")
    rows = read(spark, d, "pages").select("page_id", F.when(k % 7 == 0, "").otherwise(X.registrable_domain(F.col("url"))).alias("domain"), name.alias("name"))
    return with_domain_fit(rows, "domain", "name").select("page_id", "fits")


@query("SELECT p_partkey, 2.0::DOUBLE * (length(p_name) - p_partkey % 5) / (2 * length(p_name) - p_partkey % 5) AS tail, 2.0::DOUBLE * length(p_name) / (3 * length(p_name)) AS twice FROM part")
def q_similarity_parts(spark, d):
    tail = F.expr("substring(p_name, 1 + cast(p_partkey % 5 as int))")
    return read(spark, d, "part").select("p_partkey", ratio(F.col("p_name"), tail).alias("tail"), ratio(F.col("p_name"), F.concat("p_name", "p_name")).alias("twice"))


@query("SELECT s_suppkey AS cand_idx, true AS is_duplicate, s_name AS matched_company, 2.0::DOUBLE * (length(s_name) - 1) / (2 * length(s_name) - 1) AS score, 'aehnlicher Name (Score 0.97)' AS reason FROM supplier")
def q_match_typos(spark, d):
    """One character is left out, so only the name itself has all others in their order."""
    s = read(spark, d, "supplier")
    known = s.select(F.struct(F.lit(0), "s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.lit("").alias("url"))
    typo = F.concat(F.substring("s_name", 1, 4), F.expr("substring(s_name, 6)"), F.lit(" AG"))
    return J.match(s.select(F.col("s_suppkey").alias("cand_idx"), typo.alias("name"), F.lit("").alias("url")), known).select("cand_idx", "is_duplicate", "matched_company", "score", "reason")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS is_number, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 2 THEN -2 WHEN 3 THEN 1000 END AS whole FROM customer")
def q_numbers(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, "1.5").when(k % 6 == 1, "abc").when(k % 6 == 2, " -2 ").when(k % 6 == 3, "1e3").when(k % 6 == 4, "1,5")
    return read(spark, d, "customer").select("c_custkey", X.is_number(raw).alias("is_number"), X.whole_number(raw).cast("int").alias("whole"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTOMOBILE | BUILDING' WHEN 'MACHINERY' THEN 'MACHINERY | BUILDING' ELSE 'BUILDING' END AS canonical, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOUSEHOLD#' ELSE '' END || (c_custkey % 3)::VARCHAR AS rejected FROM customer")
def q_canonize_notes(spark, d):
    raw = F.concat("c_mktsegment", F.lit(" | building; "), (F.col("c_custkey") % 3).cast("string"))
    return read(spark, d, "customer").select("c_custkey", V.canonize(raw, "key_categories", VOC).alias("canonical"), F.array_join(V.rejected(raw, "key_categories", VOC), "#").alias("rejected"))


@query("SELECT page_id, length(e) AS n, md5(e) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS e FROM pages)")
def q_escape_html(spark, d):
    out = read(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("e"))
    return out.select("page_id", F.length("e").cast("long").alias("n"), F.md5(F.col("e").cast("binary")).alias("digest"))


@query(ISSUES + "SELECT code, count(*) AS n FROM i WHERE severity = 'error' OR code IN ('key_category_unknown', 'sub_category_unknown', 'beachhead_unknown') GROUP BY 1")
def q_strict_errors(spark, d):
    return Q.by_code(Q.errors(Q.validate(defective(spark, d), VOC, strict=True)))


@query(ISSUES + "SELECT code, count(*) AS n FROM i WHERE severity = 'warning' GROUP BY 1")
def q_warnings(spark, d):
    return Q.by_code(Q.warnings(Q.validate(defective(spark, d), VOC)))


@query(ISSUES + """SELECT code, k + 2 AS row FROM i WHERE severity = 'error' AND k IS NOT NULL
ORDER BY k, CASE code WHEN 'company_missing' THEN 1 WHEN 'row_kind_invalid' THEN 2 WHEN 'url_not_a_url' THEN 6 WHEN 'encoding_broken' THEN 8 ELSE 9 END LIMIT 40""")
def q_issue_order(spark, d):
    return Q.ordered(Q.validate(defective(spark, d), VOC), 40).select("code", "row")


@query(ISSUES + """SELECT code, k + 2 AS row, CASE code WHEN 'url_polluted' THEN 'more than an address in the URL field: ''https://a.example | b''' WHEN 'tier_invalid' THEN 'unknown tier: ''none''' WHEN 'tier_non_canonical' THEN 'other spelling of a tier: ''tier 2'''
ELSE 'unknown sub category: ''' || s || '''' END AS message FROM i JOIN c USING (k) WHERE code IN ('url_polluted', 'tier_invalid', 'tier_non_canonical', 'sub_category_unknown')""")
def q_issue_messages(spark, d):
    return Q.validate(defective(spark, d), VOC).where("code in ('url_polluted', 'tier_invalid', 'tier_non_canonical', 'sub_category_unknown')").select("code", "row", "message")


@query(TWO + f", r AS (SELECT f AS field, round_even(100.0 * count(*) FILTER (trim(coalesce(v, '')) <> '') / count(*), 0)::INT AS pct FROM t, LATERAL (VALUES {FILL}) x(f, v) GROUP BY f) SELECT field, pct, repeat('#', pct // 4) AS bar FROM r")
def q_fill_bars(spark, d):
    return P.fill_bars(P.fill_rates(two_level(spark, d), ["company", "product_name", "revenue", "location"], policy="blank"))


@query("SELECT c_name AS company, c_mktsegment AS tier, 0 AS n_details, 'b' || c_custkey % 2 AS beachhead, '2024-01-0' || 1 + c_custkey % 9 AS updated FROM customer WHERE c_mktsegment LIKE 'AUTO%' AND c_name LIKE '%0000%1%'")
def q_search_tier(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").where("c_name like '%1%'").select(
        k.alias("row_idx"), k.cast("string").alias("company_id"), F.concat(F.lit(" "), "c_name").alias("company"), nothing().alias("product_name"), F.lit("Company information").alias("row_kind"),
        F.col("c_mktsegment").alias("competitor_tier"), F.concat(F.lit("b"), (k % 2).cast("string")).alias("beachhead"), F.concat(F.lit("2024-01-0"), (1 + k % 9).cast("string"), F.lit(" 10:00:00")).alias("last_update"))
    return P.search(rows, "#0000", "AUTO")


@query(TWO + "SELECT row_idx, h AS is_header, product_name FROM t WHERE k IN (SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007')")
def q_lookup(spark, d):
    return P.lookup(two_level(spark, d), "Customer#000000007").select("row_idx", "is_header", "product_name")


@query("SELECT c_custkey AS row_idx, c_name AS company, c_mktsegment AS stage, c_nationkey::VARCHAR AS employees FROM customer WHERE c_custkey % 10 <> 0")
def q_bind(spark, d):
    """Headers in another order and of other spellings; every tenth row has no value."""
    values = {"company": F.col("c_name"), "stage": F.col("c_mktsegment"), "employees": F.col("c_nationkey")}
    cell = lambda f: F.when(F.col("c_custkey") % 10 != 0, values[f].cast("string") if f in values else nothing())
    sheet = read(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), *[cell(f).alias(f" {h.upper()}  ") for f, h in reversed(COLUMNS)])
    return bind(sheet).select("row_idx", "company", "stage", "employees")


@query(r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 <> 0)
SELECT c_name AS company, 0 AS record_pos, c_nationkey / 25.0::DOUBLE AS confidence, 'src' AS source, NULL AS product_name, CASE c_mktsegment WHEN 'FURNITURE' THEN 'BUILDING' WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS key_categories, VOC AS competitor_tier, 'Company information' AS row_kind, '2026-01-02' AS last_update FROM customer
UNION ALL SELECT c_name, pos, CASE WHEN o_orderstatus = 'O' THEN 0.25::DOUBLE ELSE c_nationkey / 25.0::DOUBLE END, 'src', 'P' || o_orderkey, NULL, NULL, 'Product', o_orderdate::DATE::VARCHAR FROM o JOIN customer ON o_custkey = c_custkey""".replace("VOC", f"'{VOC.tiers[1]}'"))
def q_read_batch(spark, d):
    """A document of one entity per customer: orders are its details, those of every fourth number nameless."""
    name = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" P"), F.col("o_orderkey").cast("string")))
    detail = F.map_from_arrays(F.array(F.lit("product_name"), F.lit("confidence"), F.lit("last_update")), F.array(name, F.when(F.col("o_orderstatus") == "O", "0.25"), F.to_date("o_orderdate").cast("string")))
    products = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.map_entries(detail).alias("p")))).alias("o"))
    head = F.create_map(F.lit("key_categories"), F.col("c_mktsegment"), F.lit("competitor_tier"), F.lit("tier 2 x"), F.lit("usp"), F.lit("N/A (x)"), F.lit("product_name"), F.lit("ignored"), F.lit("odd"), F.lit("x"))
    one = F.struct(F.concat(F.lit(" "), "c_name").alias("company"), (F.col("c_nationkey") / 25.0).alias("confidence"), F.array(F.lit(""), F.lit("src"), F.lit("src2")).alias("sources"), head.alias("company_row"), F.transform("o", lambda x: F.map_from_entries(x["p"])).alias("products"))
    raw = read(spark, d, "customer").join(products, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.array(one).alias("companies"))
    return flatten(raw, VOC, today=TODAY).records.where("usp is null").select("company", "record_pos", "confidence", "source", "product_name", "key_categories", "competitor_tier", "row_kind", "last_update")


@query(f"WITH r AS ({NUMBERED}) SELECT l_orderkey AS entry_idx, coalesce(arg_max('https://s' || l_suppkey || '.example', i) FILTER (l_suppkey % 2 = 1), '') AS url FROM r GROUP BY 1")
def q_entry_urls(spark, d):
    from pyspark.sql import Window as W

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rows = read(spark, d, "lineitem").withColumn("record_pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
    url = F.when(F.col("l_suppkey") % 2 == 1, F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example/ | x"))).otherwise("title")
    return M.entry_urls(rows.select(F.col("l_orderkey").alias("entry_idx"), "record_pos", url.alias("url")))


@query(ISSUES + "SELECT 0 AS part, k AS row_idx, CASE WHEN k % 11 = 0 THEN '' ELSE c_name END AS name, CASE WHEN k % 4 = 0 THEN 'https://a.example/' ELSE 'https://a.example | b' END AS url FROM c WHERE k % 4 < 2 UNION ALL SELECT 1, min(k), CASE WHEN k % 11 = 0 THEN '' ELSE c_name END AS n, '' FROM c GROUP BY n")
def q_known_entities(spark, d):
    k = J.known_entities(defective(spark, d), RowModel())
    return k.select(F.col("pos.col1").alias("part"), F.col("pos.row_idx").alias("row_idx"), "name", "url")


@query("WITH c AS (SELECT c_custkey % 50 AS g, c_custkey AS k FROM customer) SELECT 'id:' || g AS block_key, string_agg('https://c' || k || '.example', ' ' ORDER BY k NOT BETWEEN 50 AND 99, k) AS urls FROM c WHERE k % 3 <> 0 GROUP BY g")
def q_block_urls(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k.between(50, 99), "Company information").otherwise("Product")
    rows = read(spark, d, "customer").select(k.alias("row_idx"), (k % 50).cast("string").alias("company_id"), F.col("c_name").alias("company"), kind.alias("row_kind"), F.when(k % 3 == 0, "title").otherwise(F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example "))).alias("url"))
    return B.block_urls(rows).select("block_key", F.array_join("urls", " ").alias("urls"))


@query("SELECT count(*) AS staged FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F'")
def q_staged_count(spark, d):
    """Rows outside the table are ignored."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_orderstatus")
    form = o.select((F.col("row_idx") * F.when(F.col("row_idx") % 2 == 0, 1).otherwise(-1)).alias("row_idx"), F.lit(" F ").alias("o_orderstatus"))
    return E.staged_count(E.stage(o, form, fields=("o_orderstatus",)))


def merging(spark, d):
    """A master of the customers of odd numbers, and a batch with all of them. Names are digests, so that none are alike."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.md5(k.cast("string").cast("binary")).alias("name"), (k % 10 / 10.0).alias("sure"))
    own = {"company_id": k.cast("string"), "company": F.col("name"), "row_kind": F.lit("Company information"), "location": F.when(k % 4 == 3, "here")}
    master = c.where("c_custkey % 2 = 1").select(k.alias("row_idx"), *[own.get(f, nothing()).alias(f) for f in FIELDS])
    entries = c.select(k.alias("entry_idx"), F.concat("name", F.lit(" GmbH")).alias("company"), F.col("sure").alias("confidence"), F.array().cast("array<string>").alias("sources"))
    head = {"company": F.concat("name", F.lit(" GmbH")), "row_kind": F.lit("Company information"), "location": F.lit("there"), "stage": F.lit("S")}
    detail = {"company": F.concat("name", F.lit(" GmbH")), "row_kind": F.lit("Product"), "product_name": F.concat(F.lit("P"), (k % 3).cast("string"))}
    rows = [c.select(k.alias("entry_idx"), F.lit(i).alias("record_pos"), F.col("sure").alias("confidence"), F.lit("").alias("source"), *[v.get(f, nothing()).alias(f) for f in FIELDS]) for i, v in enumerate((head, detail))]
    return master, M.plan(master, entries, rows[0].unionByName(rows[1]), today=TODAY)


PLANNED = """WITH c AS (SELECT c_custkey AS k, md5(c_custkey::VARCHAR) AS name, c_custkey % 2 = 1 AS known, c_custkey % 10 >= 4 AS sure, c_custkey % 4 = 3 AS placed, '0.' || c_custkey % 10 || '0' AS conf FROM customer),
n AS (SELECT k, (SELECT max(k) FROM c WHERE known) + row_number() OVER (ORDER BY k) AS id FROM c WHERE NOT known AND sure),
r AS (SELECT k, 1 AS pos, k::VARCHAR AS company_id, name AS company, 'P' || k % 3 AS product_name, NULL AS location FROM c WHERE known AND sure
UNION ALL SELECT k, pos, id::VARCHAR, name || ' GmbH', CASE WHEN pos = 1 THEN 'P' || k % 3 END, CASE WHEN pos = 0 THEN 'there' END FROM n JOIN c USING (k), (VALUES (0), (1)) p(pos)),
a AS (SELECT row_number() OVER (ORDER BY k, pos) AS append_seq, * FROM r) """


@query(PLANNED + "SELECT count(*) FILTER (known AND sure) + 2 * count(*) FILTER (NOT known AND sure) AS new_rows, count(*) FILTER (known AND sure) AS updated_rows, 2 * count(*) FILTER (known AND sure) + count(*) FILTER (known AND sure AND NOT placed) AS filled_fields, 3 * count(*) FILTER (known AND NOT sure) + count(*) FILTER (known AND sure AND placed) + count(*) FILTER (NOT known AND NOT sure) AS skipped FROM c")
def q_plan_summary(spark, d):
    return merging(spark, d)[1].summary()


@query(PLANNED + "SELECT append_seq, company_id, company, product_name, location, CASE WHEN pos = 0 THEN 'Company information' ELSE 'Product' END AS row_kind, '2026-01-02' AS last_update FROM a")
def q_plan_rows(spark, d):
    return merging(spark, d)[1].new_rows.select("append_seq", "company_id", "company", "product_name", "location", "row_kind", "last_update")


@query(PLANNED + """SELECT k AS entry_idx, CASE WHEN known THEN name ELSE name || ' GmbH' END AS who, unnest(list_filter([CASE WHEN NOT known AND NOT sure THEN 'Confidence ' || conf || ' unter Schwelle' END, CASE WHEN known AND placed THEN 'location (bereits gefuellt)' END,
CASE WHEN known AND NOT sure AND NOT placed THEN 'location (Confidence ' || conf || ')' END, CASE WHEN known AND NOT sure THEN 'stage (Confidence ' || conf || ')' END, CASE WHEN known AND NOT sure THEN 'Produkt ''P' || k % 3 || ''' (Confidence ' || conf || ')' END], lambda x: x IS NOT NULL)) AS reason FROM c""")
def q_plan_skipped(spark, d):
    return merging(spark, d)[1].skipped.select("entry_idx", "who", "reason")


@query(PLANNED + "SELECT k AS entry_idx, known AS is_duplicate, CASE WHEN known THEN name END AS matched, CASE WHEN known THEN 'identischer Name (normalisiert)' END AS reason, CASE WHEN known THEN 1.0::DOUBLE END AS score FROM c")
def q_match_cascade(spark, d):
    m = merging(spark, d)[1].decided
    found = lambda c: F.when(F.col("is_duplicate"), F.col(c))
    return m.select("entry_idx", "is_duplicate", found("matched_company").alias("matched"), found("reason").alias("reason"), found("score").alias("score"))


@query(PLANNED + """SELECT k AS row_idx, name AS company, k::VARCHAR AS company_id, NULL AS product_name, CASE WHEN placed THEN 'here' WHEN sure THEN 'there' END AS location, CASE WHEN sure THEN 'S' END AS stage, CASE WHEN sure THEN '2026-01-02' END AS last_update FROM c WHERE known
UNION ALL SELECT (SELECT max(k) FROM c WHERE known) + append_seq, company, company_id, product_name, location, CASE WHEN pos = 0 THEN 'S' END, '2026-01-02' FROM a""")
def q_apply_plan(spark, d):
    master, planned = merging(spark, d)
    return M.apply_plan(master, planned).select("row_idx", "company", "company_id", "product_name", "location", "stage", "last_update")
