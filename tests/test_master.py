import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kelvane.config import FIELDS, ConflictError, IngestError, SchemaError
from kelvane.functions.vocab import Vocabulary
from kelvane.operators import blocks as B
from kelvane.operators import edits as E
from kelvane.operators import match as J
from kelvane.operators import merge as M
from kelvane.operators import profile as P
from kelvane.operators import quality as Q
from kelvane.plans import catalog_master  # noqa: F401
from kelvane.plans.ingest import apply_basket, ingest
from kelvane.sources import store as S
from kelvane.sources.xlsx import read_master
from kelvane.streaming.inbox import job_counts, watch

from helpers import MASTER_ROWS, master_frame, write_xlsx

VOC = Vocabulary.load()
DAY = "2026-01-02"


@pytest.fixture
def master(spark):
    return master_frame(spark)


def test_xlsx(spark, tmp_path):
    write_xlsx(tmp_path / "m.xlsx", MASTER_ROWS)
    df = read_master(spark, str(tmp_path / "m.xlsx"))
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r) for r in master_frame(spark).collect())
    with pytest.raises(Exception, match="missing"):
        read_master(spark, str(tmp_path / "m.xlsx"), "Nothing").count()
    assert SchemaError


def test_blocks(spark, master):
    b = {r.company: r for r in B.blocks(master).collect()}
    assert set(b) == {"Quillfern", "Ostrava Loom", "Brack & Sohn"}
    assert b["Quillfern"].company_row.location == "Graz" and [p.product_name for p in b["Quillfern"].product_rows] == ["Quillfern Bench"] and b["Quillfern"].row_indices == [0, 1]
    assert b["Brack & Sohn"].product_rows == [] and b["Ostrava Loom"].company_row is None and b["Ostrava Loom"].block_key == "id:9"
    assert B.next_id(master).first()[0] == 13
    assert B.next_id(master.limit(0)).first()[0] == 1
    urls = {r.block_key: r.urls for r in B.block_urls(master).collect()}
    assert urls == {"id:7": ["https://quillfern.at | Graz", "https://quillfern.at/bench"], "id:9": ["https://loom.example"]}
    miss = {r.block_key: r.missing for r in B.missing_fields(master, ["product_name", "location", "sub_category", "founding_year", "usp"]).collect()}
    assert miss == {"id:7": ["usp"], "id:12": ["product_name", "location", "founding_year", "usp"], "id:9": ["location", "sub_category", "founding_year", "usp"]}
    again = master_frame(spark, [*MASTER_ROWS, {**MASTER_ROWS[1], "product_name": "late header"}, {"company": " No id ", "row_kind": "x"}])
    k = P.kpis(again).first().asDict()
    assert k == {"rows": 6, "blocks": 4, "detail_rows": 4, "blocks_with_header": 2, "blocks_with_details": 2}
    assert [(r.company, r.n_details) for r in P.top_entities(again).collect()] == [("Quillfern", 2), ("Ostrava Loom", 1), ("No id", 1), ("Brack & Sohn", 0)]


def test_profile_and_search(master):
    assert [tuple(r) for r in P.tier_histogram(master).collect()] == [("Tier 1 - Direkt", 1), ("Tier 2 - Nachbar", 1), ("Tier 3 - Beobachten", 1), ("tier 1 nah", 1)]
    rates = {r.field: (r.filled, r.pct) for r in P.fill_rates(master).collect()}
    assert rates["company"] == (4, 100.0) and rates["remarks"] == (0, 0.0) and rates["product_name"] == (2, 50.0)
    assert {r.field: r.filled for r in P.fill_rates(master, policy="blank").collect()}["remarks"] == 1
    assert P.fill_rates(master.limit(0)).first().pct is None
    assert P.fill_bars(P.fill_rates(master, policy="blank")).where("field = 'company'").first().bar == "#" * 25
    assert [r.company for r in P.search(master).collect()] == ["Brack & Sohn", "Ostrava Loom", "Quillfern"]
    assert [r.company for r in P.search(master, "QUILL", "tier 1").collect()] == ["Quillfern"] and P.search(master, "_").count() == 0
    assert [r.row_idx for r in P.lookup(master, "Quillfern").collect()] == [1, 0]


def test_quality(spark, master):
    issues = Q.validate(master, VOC)
    assert {"tier_non_canonical", "url_not_a_url", "url_polluted", "encoding_broken", "company_id_not_int"} <= {r.code for r in issues.collect()}
    assert Q.stats(master).first().asDict() == {"rows": 4, "entities": 3, "header_rows": 2, "detail_rows": 2}
    rows = [{"company": "A", "row_kind": "Company information", "product_name": "p", "company_id": "1"}, {"company": "A", "row_kind": "Company information", "company_id": "1"}, {"company": "B", "row_kind": "Product", "company_id": "1"}, {"company": " ", "row_kind": "zzz"}, {"company": "C", "row_kind": "zzz", "competitor_tier": "nope", "key_categories": "UNMAPPED | bad", "beachhead": "bad,Medtech", "sub_category": "bad"}, {"company": "A", "row_kind": "Company information"}, {"company": "B", "row_kind": "Product"}, {"company": "B", "product_name": " ", "row_kind": "Product"}]
    got = Q.ordered(Q.validate(master_frame(spark, rows), VOC, strict=True), 99).select("severity", "code", "row").collect()
    assert [tuple(r) for r in got] == [
        ("error", "company_missing", 5), ("error", "row_kind_invalid", 6), ("error", "tier_invalid", 6), ("error", "key_category_unknown", 6), ("error", "key_category_unknown", 6), ("error", "sub_category_unknown", 6), ("error", "beachhead_unknown", 6), ("error", "company_id_collision", None),
        ("warning", "company_row_has_product", 2), ("warning", "product_row_no_name", 4), ("warning", "duplicate_row", 7), ("warning", "product_row_no_name", 8), ("warning", "product_row_no_name", 9), ("warning", "multiple_company_rows", None)]
    assert Q.errors(Q.validate(master_frame(spark, rows[4:5]), VOC)).count() == 2
    text = Q.render(Q.validate(master, VOC), Q.stats(master), 3)
    assert "more" in text and "errors" in text
    assert Q.by_code(issues).first().n == 4


def test_duplicate_rule_against_a_loop(spark):
    random.seed(4)
    rows = [(i, random.choice("abc"), random.choice(["", "", "p"]), random.choice("hd")) for i in range(200)]
    stored, want = {}, {}
    for i, k, p, kind in rows:
        if k in stored and (p or kind == "h"):
            want[i] = stored[k]
        else:
            stored[k] = i
    df = spark.createDataFrame(rows, "row_idx long, k string, p string, kind string")
    got = Q.duplicate_rows(df, [F.col("k")], (F.col("p") == "") & (F.col("kind") != "h")).where("same_as is not null").collect()
    assert {r.row_idx: r.same_as for r in got} == want


def test_match(spark, master):
    known = J.known_entities(master, B.MASTER)
    cases = [(0, "Quillfern GmbH", ""), (1, "Somebody", "https://www.quillfern.at/x"), (2, "Nordlicht AG", "https://nordlicht.example"), (3, "Quilfern", ""), (4, "GmbH", ""), (5, "Loom Works", "https://loom.example/about")]
    got = {r.cand_idx: r for r in J.match(spark.createDataFrame(cases, "cand_idx long, name string, url string"), known).collect()}
    assert [got[i].matched_company if got[i].is_duplicate else None for i in range(6)] == ["Quillfern", "Quillfern", None, "Quillfern", None, "Ostrava Loom"]
    assert got[1].reason == "gleiche Domain (quillfern.at)" and got[3].score == SequenceMatcher(None, "quilfern", "quillfern").ratio() and got[4].reason == "leerer Firmenname"


def loop(cases):
    """The greedy pass itself."""
    out, d, n = {}, set(), set()
    for i, dom, norm, dup in cases:
        again = bool(dom and dom in d or norm and norm in n)
        out[i] = (not again and not dup, again)
        if not again and not dup:
            d.add(dom)
            n.add(norm)
    return out


def decided(spark, cases, **options):
    df = spark.createDataFrame(cases, "cand_idx long, domain string, norm string, is_duplicate boolean").withColumn("matched_company", F.lit("k")).withColumn("reason", F.lit("r"))
    return {r.cand_idx: (r.is_fresh, r.duplicate_of == J.IN_BATCH[0]) for r in J.partition(df, **options).collect()}


def test_partition_of_random_candidates(spark):
    rng = random.Random(9)
    cases = [(i, rng.choice(["", *"abcdefghijkl"]), rng.choice(["", *"mnopqrstuv"]), rng.random() < 0.2) for i in range(250)]
    assert decided(spark, cases) == loop(cases)


def test_partition_of_long_chains(spark):
    """Each shares its domain with the one before and its name with the one after, in order and out of it."""
    chain = [(i, f"d{i // 2}", f"n{(i + 1) // 2}", False) for i in range(1000)]
    places = list(range(1000, 2000))
    random.Random(3).shuffle(places)
    mixed = sorted((p, f"e{i // 2}", f"m{(i + 1) // 2}", i % 97 == 0) for i, p in enumerate(places))
    hub = [(3000 + i, "hub", f"h{i % 40}", False) for i in range(300)]
    cases = [*chain, *mixed, *hub]
    assert decided(spark, cases, rounds=2) == loop(cases)


def test_fuzzy_against_a_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abce 12&") for _ in range(rng.randrange(1, 14))).strip()
    known = sorted({w for w in (word() for _ in range(150)) if w})
    asked = sorted({w for w in (word() for _ in range(60)) if w} - set(known))
    names = spark.createDataFrame([(k, k.upper(), i) for i, k in enumerate(known)], "norm string, n_name string, n_pos int")
    rows = spark.createDataFrame(list(enumerate(asked)), "cand_idx long, norm string")
    want = {}
    for i, a in enumerate(asked):
        best = max(((SequenceMatcher(None, a, k).ratio(), -j) for j, k in enumerate(known) if k[0] == a[0]), default=None)
        if best and best[0] > 0:
            want[i] = (known[-best[1]].upper(), best[0])
    got = {r.cand_idx: (r.f_name, r.f_score) for r in J.fuzzy(rows, names, "cand_idx", exact_best=True).collect()}
    assert len(want) > 40 and got == want
    sure = {r.cand_idx: (r.f_name, r.f_score) for r in J.fuzzy(rows, names, "cand_idx", 0.8).collect() if r.f_score >= 0.8}
    assert sure == {i: v for i, v in want.items() if v[1] >= 0.8}


def test_fuzzy_by_segments_against_a_loop(spark):
    """Names of 1 to 30 characters with up to six edits, of which the best are ties, near the threshold or below it."""
    rng = random.Random(8)
    known = sorted({"a" + "".join(rng.choice("abc1 ") for _ in range(rng.randrange(30))).rstrip() for _ in range(150)})

    def edited(name):
        chars = list(name)
        for _ in range(rng.randrange(1, 7)):
            at = rng.randrange(1, len(chars) + 1)
            chars[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "1"])
        return "".join(chars)

    asked = sorted({edited(rng.choice(known)) for _ in range(300)} - set(known))
    names = spark.createDataFrame([(k, k.upper(), i) for i, k in enumerate(known)], "norm string, n_name string, n_pos int")
    rows = spark.createDataFrame(list(enumerate(asked)), "cand_idx long, norm string")
    want = {}
    for i, a in enumerate(asked):
        score, at = max((SequenceMatcher(None, a, k).ratio(), -j) for j, k in enumerate(known))
        want[i] = (known[-at].upper(), score)
    assert {r.cand_idx: (r.f_name, r.f_score) for r in J.fuzzy(rows, names, "cand_idx", exact_best=True).collect()} == want
    for threshold in (0.8, 0.9):
        close = {i: v for i, v in want.items() if v[1] >= threshold}
        assert len(close) > 50
        assert {r.cand_idx: (r.f_name, r.f_score) for r in J.fuzzy(rows, names, "cand_idx", threshold).collect()} == close


def test_fuzzy_compares_few_names(spark, monkeypatch):
    """Candidates that have a close name are not compared with all names of their first character."""
    seen = []
    real = J.ratio
    monkeypatch.setattr(J, "ratio", lambda a, b: seen.append(1) or real(a, b))
    monkeypatch.setattr(J, "shared_bound", lambda a, b: pytest.fail("all pairs"))
    known = spark.range(3000).selectExpr("struct(0, id) AS pos", "concat('Supplier#', lpad(id, 9, '0')) AS name", "'' AS url")
    asked = spark.range(3000).selectExpr("id AS cand_idx", "concat('Suppier#', lpad(id, 9, '0'), ' AG') AS name", "'' AS url")
    got = J.match(asked, known).collect()
    assert len(got) == 3000 and seen and all(r.is_duplicate and r.matched_company == f"Supplier#{r.cand_idx:09}" and r.score == 34 / 35 for r in got)


def test_names_are_compared_in_many_tasks(spark, monkeypatch):
    """Few names are few bytes, but the comparisons and the normalised names are dealt to all cores."""
    tasks, cores = [], spark.sparkContext.defaultParallelism
    real = J._best
    monkeypatch.setattr(J, "_best", lambda pairs: tasks.append(pairs.rdd.getNumPartitions()) or real(pairs))
    known = spark.range(500).selectExpr("struct(0, id) AS pos", "md5(cast(id AS string)) AS name", "'' AS url")
    asked = spark.range(500).selectExpr("id AS cand_idx", "concat(substring(md5(cast(id AS string)), 1, 9), substring(md5(cast(id AS string)), 11), ' AG') AS name", "'' AS url")
    got = J.match(asked, known)
    assert got.where("is_duplicate and score = 62 / 63D").count() == 500 and tasks == [2 * cores]


def test_plan_compares_few_names(spark, monkeypatch):
    """A plan doesn't compare new entities with all names; the matches do when asked for, and decide alike."""
    real, listed = J.shared_bound, []
    monkeypatch.setattr(J, "shared_bound", lambda a, b: listed.append(1) or real(a, b))
    planned = merging_names(spark)
    decided = {r.entry_idx: r for r in planned.decided.collect()}
    assert planned.new_rows.count() == 1 and planned.updates.count() == 1 and not listed
    assert [decided[i].is_duplicate for i in range(3)] == [True, False, False] and decided[0].matched_company == "Quillfern"
    assert decided[1].score is None and (decided[2].reason, decided[2].score) == (J.NO_NAME, 0.0)
    every = {r.entry_idx: r for r in planned.matches.collect()}
    assert listed and [every[i].is_duplicate for i in range(3)] == [True, False, False] and every[0] == decided[0]
    best = max((SequenceMatcher(None, "quarnfell", k).ratio(), k) for k in ("quillfern",))
    assert (every[1].matched_company, every[1].score, every[1].reason) == ("Quillfern", best[0], f"kein Treffer (bester Score {best[0]:.2f})")


@pytest.mark.parametrize("name", ["q_apply_plan", "q_match_cascade", "q_plan_rows", "q_plan_skipped", "q_plan_summary"])
def test_planning_queries_compare_few_names(spark, monkeypatch, name):
    """No query on a plan lists all pairs of names."""
    from kelvane.plans.catalog import QUERIES

    monkeypatch.setattr(J, "shared_bound", lambda a, b: pytest.fail("all pairs"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_plan_frames_are_built_when_asked_for(spark):
    """New rows build neither the states of fields nor updates, and what is skipped builds no updates."""
    planned = merging_names(spark)
    assert planned.new_rows.count() == 1 and not {"updates", "skipped", "filled", "_fills"} & set(vars(planned))
    assert [(r.who, r.reason) for r in planned.skipped.collect()] == [(" ", "Confidence 0.10 unter Schwelle")] and not {"updates", "filled"} & set(vars(planned))
    # The states of fields are found on all cores, however few bytes the rows are.
    assert planned._fills.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    # Counts build no rows.
    got = planned.summary().first().asDict()
    assert not {"updates", "filled"} & set(vars(planned))
    assert got == {"new_rows": planned.new_rows.count(), "updated_rows": planned.updates.count(), "filled_fields": planned.filled.count(), "skipped": planned.skipped.count()}
    assert got == {"new_rows": 1, "updated_rows": 1, "filled_fields": 1, "skipped": 1}


@pytest.mark.parametrize("zero_is_empty", [True, False])
def test_blank_fields_as_text(spark, zero_is_empty):
    values = [None, "", " ", "\u00a0\t\n", "0", " 0.0 ", "-0e0", "1", "a\n", "\n a", "\\S", "0x"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select(F.expr(M._blank("v", zero_is_empty)).alias("a"), M.X.is_blank(F.col("v"), zero_is_empty).alias("b"), F.expr(M._given("v")).alias("c"), (~M.X.is_missing(F.col("v"))).alias("d")).collect()
    assert [(r.a, r.c) for r in got] == [(r.b, r.d) for r in got] and len({r.a for r in got}) == len({r.c for r in got}) == 2


def merging_names(spark):
    entries = spark.createDataFrame([(0, "Quillfernn", 0.9, []), (1, "Quarnfell", 0.9, []), (2, " ", 0.1, [])], "entry_idx long, company string, confidence double, sources array<string>")
    kinds = "entry_idx long, record_pos int, confidence double, source string, " + ", ".join(f"{f} string" for f in FIELDS)
    records = spark.createDataFrame([(i, 0, 0.9, "", *[{"company": n, "stage": "S", "row_kind": "Company information"}.get(f) for f in FIELDS]) for i, n in enumerate(("Quillfernn", "Quarnfell", " "))], kinds)
    return M.plan(master_frame(spark), entries, records, today=DAY)


def batch_file(tmp_path, companies):
    path = tmp_path / "records.json"
    path.write_text(json.dumps({"run": {"x": "y"}, "companies": companies}), encoding="utf-8-sig")
    return str(path)


NEWCOMER = {"company": "Halvorsen Rig", "confidence": 0.72, "sources": ["https://a.example/1", ""], "company_row": {"url": "https://halvorsen-rig.example", "location": "Bergen", "stage": "Seed", "competitor_tier": "tier 2 x", "beachhead": "Medtech", "key_categories": "Manufacturing & Factory", "hobby": "x"}, "products": [{"product_name": "Rig One", "sub_category": "CAM & CNC", "usp": "n/a"}, {"usp": "no name"}]}
KNOWN = {"company": "Quillfern", "confidence": 0.66, "company_row": {"stage": "Series C", "location": "Linz"}, "products": [{"product_name": "QUILLFERN bench "}, {"product_name": "Bench Two", "confidence": "0.2"}, {"product_name": "Bench Two"}, {"product_name": "BENCH TWO"}]}
UNSURE = {"company": "Pale Lantern", "confidence": 0.3, "company_row": {"url": "https://lantern.example"}}


def test_ingest(spark, tmp_path, master):
    store = S.VersionStore(spark, str(tmp_path / "db"))
    assert store.write(master, "4.9") == "4.9"
    path = batch_file(tmp_path, [KNOWN, UNSURE, NEWCOMER])
    out = ingest(spark, store, path, today=DAY, out_dir=str(tmp_path / "out"), stamp="s1")
    assert (out.code, out.version, store.latest()) == (0, "4.10", "4.10")
    rows = {r.row_idx: r for r in store.read().collect()}
    assert len(rows) == 7 and rows[1].stage == "Series C" and rows[1].location == "Graz" and rows[1].last_update == DAY
    assert (rows[4].product_name, rows[4].company_id, rows[4].row_kind) == ("Bench Two", "7.0", "Product")
    assert (rows[5].company, rows[5].company_id, rows[5].competitor_tier, rows[5].key_categories) == ("Halvorsen Rig", "13", VOC.tiers[1], "3. Manufacturing & Production (CAM/MES)")
    assert (rows[6].product_name, rows[6].usp, rows[6].company_id) == ("Rig One", None, "13")
    skips = {(r.who, r.reason) for r in out.plan.skipped.collect()}
    assert skips == {("Quillfern", "location (bereits gefuellt)"), ("Quillfern", "Produkt 'QUILLFERN bench' existiert"), ("Quillfern", "Produkt 'Bench Two' (Confidence 0.20)"), ("Quillfern", "Produkt 'BENCH TWO' existiert"), ("Pale Lantern", "Confidence 0.30 unter Schwelle")}
    assert out.plan.summary().first().asDict() == {"new_rows": 3, "updated_rows": 1, "filled_fields": 3, "skipped": 5}
    assert (tmp_path / "out/run_s1/report.md").exists() and S.runs(spark, str(tmp_path / "out")).first().run == "run_s1" and "hobby" in S.run_report(spark, str(tmp_path / "out"), "run_s1")
    assert S.run_report(spark, str(tmp_path / "out"), "../x") is None
    assert json.loads((tmp_path / "out/run_s1/plan.json").read_text())["updated_rows"] == 1
    again = ingest(spark, store, path, today=DAY, dry_run=True)
    assert again.code == 0 and store.latest() == "4.10" and again.plan.filled.count() == 0 and again.plan.new_rows.count() == 0


def test_batches_that_break_the_contract(spark, tmp_path, master):
    store = S.VersionStore(spark, str(tmp_path / "db"))
    store.write(master)
    for content in ("[1, 2", '{"run": {"a": "b"}}', '{"companies": []}', '{"companies": [{"confidence": 1}]}'):
        (tmp_path / "bad.json").write_text(content)
        with pytest.raises(IngestError):
            ingest(spark, store, str(tmp_path / "bad.json"), today=DAY)
    bad = ingest(spark, store, batch_file(tmp_path, [{**NEWCOMER, "company_row": {"url": "see brochure"}}]), today=DAY)
    assert bad.code == 2 and "url_not_a_url" in bad.report
    with pytest.raises(Exception):
        store.write(master, "1.0")


def test_later_entry_wins_unless_folded(spark, master):
    records = spark.createDataFrame([(0, 0, 0.9, "Series B", None), (1, 0, 0.9, None, "12")], "entry_idx int, record_pos int, confidence double, stage string, employees string")
    from kelvane.config import FIELDS

    records = records.select("entry_idx", "record_pos", "confidence", F.lit("").alias("source"), *[F.lit("Quillfern").alias(f) if f == "company" else F.col(f) if f in ("stage", "employees") else F.lit(None).cast("string").alias(f) for f in FIELDS])
    entries = spark.createDataFrame([(0, "Quillfern", 0.9, []), (1, "Quillfern", 0.9, [])], "entry_idx int, company string, confidence double, sources array<string>")
    up = M.plan(master, entries, records, today=DAY).updates.collect()
    assert [(r.stage, r.employees) for r in up] == [(None, "12")]
    up = M.plan(master, entries, records, today=DAY, fold=True).updates.collect()
    assert [(r.stage, r.employees) for r in up] == [("Series B", "12")]


def test_edits(spark, tmp_path, master):
    store = S.VersionStore(spark, str(tmp_path / "db"))
    version = store.write(master)
    form = master.where("row_idx in (0, 1)").withColumn("location", F.lit("Wels")).withColumn("url", F.when(F.col("row_idx") == 1, "").otherwise(F.col("url"))).withColumn("row_idx", F.when(F.col("row_idx") == 0, 77).otherwise(F.col("row_idx")))
    basket = E.stage(master, form)
    assert sorted((r.field, r.new_value) for r in basket.collect()) == [("location", "Wels"), ("url", "")]
    assert sorted((r.field, r.old_value, r.new_value) for r in E.differences(master, basket).collect()) == [("location", "Graz", "Wels"), ("url", MASTER_ROWS[1]["url"], "")]
    assert E.unstage(basket, 1, "url").count() == 1 and E.staged_count(basket).first()[0] == 2
    path = str(tmp_path / "basket")
    assert S.load_basket(spark, path).count() == 0
    S.save_basket(basket, path, version)
    new = apply_basket(store, S.load_basket(spark, path), today=DAY)
    row = store.read(new).where("row_idx = 1").first()
    assert (row.location, row.url, row.last_update, row.competitor_tier) == ("Wels", None, DAY, "tier 1 nah")
    with pytest.raises(ConflictError):
        apply_basket(store, S.load_basket(spark, path), today=DAY)


def test_versions_jobs_and_streams(spark, tmp_path, master):
    names = spark.createDataFrame([("a/M_v2.9.xlsx", 0), ("b/M_v2.10.xlsx", 1), ("c/M_v2.10.xlsx", 2), ("M_v9.xlsx", 0)], "path string, priority int")
    assert S.latest_name(names).first()[0] == "b/M_v2.10.xlsx"
    jobs = str(tmp_path / "jobs")
    for i in range(3):
        S.add_job(spark, jobs, modus="m", stamp=f"2026010{i}_000000")
    assert [r.name for r in S.jobs(spark, jobs, 2).collect()] == ["auftrag_20260101_000000.json", "auftrag_20260102_000000.json"]
    q = job_counts(spark, jobs).writeStream.outputMode("complete").format("memory").queryName("job_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select modus, status, n from job_counts").first() == ("m", "offen", 3)
    store = S.VersionStore(spark, str(tmp_path / "db"))
    store.write(master)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"companies": [NEWCOMER]}))
    seen = []
    watch(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"), today=DAY, on_outcome=lambda p, o: seen.append(o.version)).awaitTermination()
    assert seen == ["1.1"] and store.read().count() == 6


def test_workbook_versions(spark, tmp_path, capsys):
    """A new file has the changed cells, what lies around them, and reads back as the merged table does."""
    import zipfile

    from kelvane.__main__ import main
    from kelvane.sources.workbook import column_name, latest_workbook, rewrite_sheet

    source, out = tmp_path / "Stand_v1.9.xlsx", tmp_path / "out"
    out.mkdir()
    write_xlsx(source, MASTER_ROWS)
    before = source.read_bytes()
    path = batch_file(tmp_path, [KNOWN, NEWCOMER])
    args = ["ingest", path, "--db", str(source), "--out-dir", str(out)]
    assert main([*args, "--dry-run"], spark) == 0 and list(out.iterdir()) == []
    assert main(args, spark) == 0 and source.read_bytes() == before
    new = out / "Stand_v1.10.xlsx"
    rows = {r.row_idx: r for r in read_master(spark, str(new)).collect()}
    assert sorted(rows) == list(range(7)) and rows[1].stage == "Series C" and rows[1].location == "Graz" and rows[0].url == MASTER_ROWS[0]["url"]
    assert [rows[i].product_name for i in (4, 5, 6)] == ["Bench Two", None, "Rig One"] and rows[5].company_id == "13" and not rows[5].company_id_is_float
    assert set(zipfile.ZipFile(new).namelist()) == set(zipfile.ZipFile(source).namelist())
    assert latest_workbook(spark, [str(tmp_path / "none"), str(tmp_path), str(out)]) == str(new)
    assert latest_workbook(spark, [str(tmp_path / "none")]) is None
    (tmp_path / "bad.json").write_text("[")
    assert main(["ingest", str(tmp_path / "bad.json"), "--db", str(source), "--out-dir", str(out)], spark) == 2
    capsys.readouterr()
    assert main(["validate", "--db", str(new)], spark) == 1 and main(["stats", "--db", str(new)], spark) == 0 and main(["doctor", str(out)], spark) == 0
    text = capsys.readouterr().out
    assert "encoding_broken" in text and "Tier 3 - Beobachten" in text and "Stand_v1.10.xlsx" in text
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    xml = '<w><dimension ref="A1"/><cols/><sheetData><row r="1" spans="1:2"><c r="A1" s="3"/><c r="B1" t="s"><v>0</v></c></row><row r="2" ht="9"/><row r="5"><c r="A5"><v>1</v></c></row></sheetData><end/></w>'
    got = rewrite_sheet(xml, {0: {0: "a<b", 2: None}}, [{1: "p"}, {1: "7"}, {0: "q"}, {0: "2"}], [0], 1, {0})
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
    assert got == ('<w><cols/><sheetData><row r="1"><c r="A1" s="3" t="inlineStr"><is><t xml:space="preserve">a&lt;b</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1"/></row><row r="2" ht="9"/>'
        f'<row r="3">{cell("B3", "p")}</row><row r="4">{cell("B4", "7")}</row><row r="5">{cell("A5", "q")}</row><row r="6"><c r="A6"><v>2</v></c></row></sheetData><end/></w>')
