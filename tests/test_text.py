import pytest
from pyspark.sql import functions as F

from kelvane.config import SchemaError
from kelvane.functions import text as X
from kelvane.functions import vocab as V
from kelvane.functions.similarity import ratio, with_domain_fit
from kelvane.sources.headers import normalize_header, resolve_columns
from kelvane.sources.store import bump_name, bumped

VOC = V.Vocabulary.load()


def check(spark, fn, cases, kind="string"):
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], f"i int, given string, want {kind}")
    got = rows.select("given", "want", fn(F.col("given")).alias("got")).collect()
    assert [(r.given, r.got) for r in got] == [(r.given, r.want) for r in got]


def test_first_url(spark):
    check(spark, X.first_url, [("see https://quillfern.at/ | Graz | seit 2011", "https://quillfern.at"), ("https://one.example\nhttps://two.example", "https://one.example"), ("Startseite | Produkte", ""), ("1998", ""), ("Graz, Austria", ""), ("", ""), (None, ""), ("HTTPS://Up.Example/;", "HTTPS://Up.Example"), ("a,https://b.example,c", "https://b.example")])


def test_registrable_domain(spark):
    check(spark, X.registrable_domain, [("https://www.quillfern.at/about", "quillfern.at"), ("https://shop.bristle.co.uk/a", "bristle.co.uk"), ("loom.example", "loom.example"), ("Startseite | Brack", ""), ("", ""), (None, ""), ("https://me:pw@www.oak.co.uk:81/a", ""), ("http://192.168.7.9/x", "7.9"), ("https://k.l.m.org:8443?x", "m.org"), ("two words.at", "")])


def test_normalize_company(spark):
    check(spark, X.normalize_company, [("Quillfern GmbH", "quillfern"), ("x2 Weaving, Inc.", "x2 weaving"), ("Nordlicht Werke SE", "nordlicht werke"), ("AG & Co. KG", "ag &"), ("Polder N.V.", "polder n v"), ("The Copper Company", "copper"), ("Föhn", "f hn"), (None, ""), ("the", "")])


def test_empties(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" \t",), ("0",), ("N/A (x)",), ("n/able Inc",), (" x ",)], "c string")
    got = df.select(X.is_missing(F.col("c")), X.is_blank(F.col("c")), X.is_blank(F.col("c"), True), X.is_unknown(F.col("c")), X.clean(F.col("c"))).collect()
    assert [tuple(r)[:4] for r in got] == [(True, True, True, True), (True, True, True, True), (False, True, True, True), (False, True, True, True), (False, False, True, False), (False, False, False, True), (False, False, False, True), (False, False, False, False)]
    assert [r[4] for r in got] == [None] * 4 + ["0", None, None, "x"]


def test_tier(spark):
    d, n, b = VOC.tiers
    check(spark, lambda c: X.canon_tier(c, list(VOC.tiers)), [("Tier 1 / naheliegend", d), (" TIER 2", n), ("tier 2 – Nachbar", n), ("Tier 3 \ufffd fern", b), ("Tier3", b), ("Tier 21", None), ("tier 3rd", None), ("fern", None), ("", None), (None, None)])


def test_vocabulary(spark):
    check(spark, lambda c: V.canon(c, "key_categories", VOC), [("Manufacturing & Factory", "3. Manufacturing & Production (CAM/MES)"), ("7. Testing & Validation", "8. Specialized & Cross-cutting"), ("2.  simulation & ANALYSIS (cae)", "2. Simulation & Analysis (CAE)"), ("UNMAPPED", None), ("gibberish", None)])
    check(spark, lambda c: V.canon(c, "sub_category", VOC), [("8. Other / Cross-cutting", "Other / Cross-cutting"), ("AI & ML Tools", "Engineering Copilots & AI Assistants")])
    check(spark, lambda c: V.canonize(c, "beachhead", VOC), [("Medtech, machinery | nope", "Medtech, Machinery"), ("nope", None), (None, None)])
    check(spark, lambda c: F.array_join(V.rejected(c, "key_categories", VOC), "#"), [("UNMAPPED | x; 7. Supply Chain & Operations", "UNMAPPED#x"), (None, "")])
    assert (len(VOC.key_categories), len(VOC.sub_categories), len(VOC.legend), sum(map(len, VOC.legend.values()))) == (8, 30, 8, 52)
    assert all(s in VOC.sub_categories for v in VOC.legend.values() for s in v) and {s for v in VOC.legend.values() for s in v} == set(VOC.sub_categories)
    assert VOC.subs_for("nothing") == VOC.sub_categories and len(VOC.subs_for(VOC.key_categories[3])) == 4
    assert VOC.terms(spark).where("canonical is null").count() == 1


def test_split_and_join(spark):
    check(spark, lambda c: F.array_join(X.split_multi(c), "#"), [("A | B; C", "A#B#C"), (None, ""), (" ;| x,y ", "x,y")])
    check(spark, lambda c: X.join_multi(F.split(c, "#"), " | "), [("A#B#A", "A | B"), (" #X# ", "X")])


def test_numbers(spark):
    check(spark, lambda c: X.is_number(c), [("42.9", True), ("1e3", True), ("1_0", True), ("1d", False), ("nan", True), ("", False), ("x", False), (".5", True), ("-inf", True)], "boolean")
    check(spark, X.whole_number, [("42.9", 42), ("-1.5", -1), ("1_0", 10), ("nan", None), ("inf", None), ("x", None), (None, None), ("1d", None)], "long")


def test_similarity(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [0.25, 0.5, None]
    fit = spark.createDataFrame([("quillfern.at", "Quillfern GmbH"), ("quillfern.at", "Brack"), ("loom.example", "Ostrava Loom"), ("", "x"), ("quilfren.at", "Quillfern")], "domain string, name string")
    assert {(r.domain, r.name): r.fits for r in with_domain_fit(fit, "domain", "name").collect()} == {("quillfern.at", "Quillfern GmbH"): True, ("quillfern.at", "Brack"): False, ("loom.example", "Ostrava Loom"): True, ("", "x"): False, ("quilfren.at", "Quillfern"): True}


def test_headers():
    from kelvane.config import COLUMNS

    heads = [h for _, h in COLUMNS]
    heads[9] = "R-Strategies: see\nsecond sheet"
    heads[14] = " KEY\n customers "
    at = resolve_columns(["extra", *reversed(heads)])
    assert len(at) == 31 and at["company_id"] == 31 and at["r_strategies"] == 22
    assert normalize_header(" Two\n LINES ") == "two lines" and normalize_header(None) == ""
    with pytest.raises(SchemaError):
        resolve_columns(["Company", "URL"])


@pytest.mark.parametrize(("name", "version", "want"), [("K_v4.1.xlsx", None, "K_v4.2.xlsx"), ("K_v4.1.xlsx", "7.0", "K_v7.0.xlsx"), ("K_v0.19.xlsx", None, "K_v0.20.xlsx"), ("K_v4.1b.xlsx", "4.2", "K_v4.2.xlsx"), ("K_v3.3_lang.xlsx", "5.1", "K_v5.1.xlsx"), ("Stamm.xlsx", "1.1", "Stamm_v1.1.xlsx"), ("Stamm.xlsx", None, "Stamm_enriched_260102.xlsx")])
def test_bump(spark, name, version, want):
    assert bump_name(name, version, stamp="260102") == want
    assert spark.range(1).select(bumped(F.lit(name), version, "260102")).first()[0] == want


def test_mojibake(spark):
    check(spark, X.has_mojibake, [("Ã¶", True), ("�", True), ("â€\u0099", True), ("â€™", False), ("ok", False), (None, False)], "boolean")


def test_escape_html(spark):
    check(spark, X.escape_html, [("a < b & \"c\"", "a &lt; b &amp; &quot;c&quot;"), ("it's > 1 &amp;", "it&#x27;s &gt; 1 &amp;amp;"), (None, ""), ("", "")])
