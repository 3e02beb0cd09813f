import random
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from kelvane.llm import cotrain, exact, graph, lines, mixing, models, packing, simhash, sketch, substring, toxicity, url_filter
from kelvane.llm.common import Scratch
from kelvane.llm.words import WordHashes

#: Nulls, empty and blank texts, ties, a very long text, repeated rows.
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, LONG), (9, LONG + " end"), (10, "é ü \u00a0 x\u2003y"), (11, "x " * 80)]


def docs(spark, rows=ODD):
    """Documents beside columns whose names operators might use themselves."""
    df = spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(1).alias(c) for c in ("size", "target", "key", "bucket", "score", "rank", "length", "label", "rest", "fp", "node", "h", "d", "row", "weight", "seed", "mask")])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark).limit(0)


def test_exact(spark, empty):
    got = rows(exact.radix_groups(docs(spark), first=2, factor=3))
    by = {}
    for i, t in ODD:
        by.setdefault(t or "", []).append(i)
    assert got == sorted(((i, max(by[t or ""]), len(by[t or ""]), brute.sha(t or "")) for i, t in ODD), key=str)
    assert exact.radix_groups(empty).count() == 0
    assert rows(exact.radix_groups(spark.createDataFrame([(None, "x"), (None, "x"), (3, "y")], "doc_id long, text string")))[0][0] == 3


def test_simhash(spark, empty):
    random.seed(1)
    base = ["".join(random.choice("abcde ") for _ in range(300)) for _ in range(12)]
    many = ODD[:6] + [(100 + i, (b := random.choice(base))[: 150 - i % 7] + random.choice(["", "z"]) + b[150:]) for i in range(60)]
    got = {r.doc_id: (f"{r.fp & simhash.FULL:016x}", r.component_id) for r in simhash.near_groups(docs(spark, many), limit=8).collect()}
    assert got == brute.simhash(many)
    assert simhash.near_groups(empty).count() == 0


def test_trie_against_all_pairs():
    rng = np.random.default_rng(1)
    for width, budget in ((64, 2), (32, 3), (12, 1)):
        keys = np.sort(rng.integers(0, 2 ** min(width, 62), 150, dtype=np.uint64))
        keys = np.sort(np.concatenate([keys, keys[:60] ^ np.uint64(1), keys[:30], keys[:30] ^ np.uint64(5)]))
        bounds = np.array([0, 100, len(keys)])
        got = [(a, b) for i, j in simhash.trie_pairs(keys, bounds, budget, width) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(a, b) for lo, hi in ((0, 100), (100, len(keys))) for a in range(lo, hi) for b in range(a + 1, hi) if bin(int(keys[a] ^ keys[b])).count("1") <= budget}
        assert len(got) == len(want) and set(got) == want


def test_trie_links_of_crowded_groups(spark):
    rng = np.random.default_rng(4)
    for width, budget, bits in ((64, 2, range(45, 64)), (64, 2, range(19)), (32, 3, range(8, 22))):
        base, bits = int(rng.integers(0, 2**62)) & ((1 << width) - 1), list(bits)
        keys = {base ^ 1 << b for b in bits} | {base} | {base ^ sum(1 << int(b) for b in rng.choice(bits, 7, replace=False)) for _ in range(150)}
        keys = sorted(k - (1 << 64) if k >> 63 else k for k in keys)
        table = Scratch(spark).keep(spark.createDataFrame([(0, k, i) for i, k in enumerate(keys)], "t_table int, key long, node long"))
        got = [(r.src, r.dst) for r in simhash.trie_links(table, budget, 4, width).collect()]
        codes = np.array(keys, np.int64).view(np.uint64)
        want = [(x, int(y)) for x in range(len(keys)) for y in np.flatnonzero(np.bitwise_count(codes[x] ^ codes[x + 1 :]) <= budget) + x + 1]

        def roots(pairs):
            return {x: min(x, y) for star in graph.contract(iter(pairs)) for x, y in star}

        assert want and roots(got) == roots(want)


def test_near_copies(spark, empty):
    random.seed(2)
    text = [f"w{random.randrange(5000)}" for _ in range(400)]
    changed = [w if i % 130 else "zzz" for i, w in enumerate(text)]
    other = [f"w{random.randrange(5000)}" for _ in range(400)]
    many = [(5, " ".join(text)), (2, " ".join(changed)), (3, " ".join(other)), (9, None), (8, ""), (3, " ".join(other))]
    kept = simhash.one_of_each(docs(spark, many))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8] and kept.columns == docs(spark).columns
    assert simhash.one_of_each(empty).count() == 0


def test_near_copies_at_the_threshold(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    many = []
    for n in (4, 8, 9, 12, 16, 40, 99, 110, 300, 900):
        for share in (0.5, 0.7, 0.78, 0.79, 0.8, 0.81, 0.83, 0.9):
            for cut in (False, True):  # J = common / (common + left + right)
                base = [word() for _ in range(n + 4)]  # n shingles
                left = max(1, round(n * (1 - share))) if cut else max(1, round(n * (1 - share) / (1 + share)))
                other = [*base[:-left], *([] if cut else [word() for _ in range(left)])]
                many += [(len(many), " ".join(base)), (len(many) + 1, " ".join(other))]
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))) for _, t in many]
    gone = {b for b in range(1, len(many), 2) if 5 * len(sets[b - 1] & sets[b]) >= 4 * len(sets[b - 1] | sets[b])}
    kept = {r.doc_id for r in simhash.one_of_each(docs(spark, many)).collect()}
    assert len(gone) > 40 and kept == {i for i, _ in many} - gone


def test_large_clusters_and_common_shingles(spark):
    """Small limits send every group through the paths of crowded prefixes, dense keys and the grid of a large component."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(word() for _ in range(12))
    many = []
    for size, copies, most in ((140, 330, 9), (60, 40, 3), (400, 30, 8), (30, 60, 2)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(most)):
                text[rng.randrange(size)] = word()
            many.append((len(many), " ".join(text)))
    many += [(len(many) + i, f"{common} " + " ".join(word() for _ in range(rng.randrange(4)))) for i in range(80)]
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))) for _, t in many]
    pairs = [(a, b) for b in range(len(many)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {x: min(x, y) for star in graph.contract(iter(pairs)) for x, y in star}
    want = {i: root.get(i, i) for i, _ in many}
    for options in ({}, {"limit": 20, "verified": 3000}):
        got = {r.d: r.component_d for r in simhash.near_copies(docs(spark, many), **options).collect()}
        assert got == want


def alike(docs):
    """The smallest id that pairs of a similarity of at least 0.8 reach, from all pairs."""
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))) for _, t in docs]
    pairs = [(a, b) for b in range(len(docs)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {x: min(x, y) for star in graph.contract(iter(pairs)) for x, y in star}
    return {i: root.get(i, i) for i, _ in docs}


def test_links_between_nodes_of_different_leaders(spark):
    """Chains in components of which each is larger than a task: two nodes, each alike another leader only, are alike."""
    rng = random.Random(11)
    many = []
    for _ in range(24):
        text = [f"w{rng.randrange(10**6)}" for _ in range(64 + 6 * 9)]
        many += [(len(many) + i, " ".join(text[6 * i : 6 * i + 64])) for i in range(10)]
    want = alike(many)
    assert len(set(want.values())) == 24
    assert {r.d: r.component_d for r in simhash.near_copies(docs(spark, many), verified=100).collect()} == want


def test_long_texts_that_no_table_pairs(spark):
    """With few tables SimHash misses many pairs of long texts at the threshold; none is lost."""
    rng = random.Random(13)
    many = []
    for _ in range(80):
        text = [f"w{rng.randrange(10**6)}" for _ in range(184 + 20)]
        many += [(len(many), " ".join(text[:184])), (len(many) + 1, " ".join(text[20:]))]
    want = alike(many)
    assert len(set(want.values())) == 80
    assert {r.d: r.component_d for r in simhash.near_copies(docs(spark, many), tables=6).collect()} == want


def test_spread():
    rng = np.random.default_rng(5)
    for n, p in ((1, 0.5), (40, 0.03), (200, 0.004), (60, 0.9)):
        linked = np.triu(rng.random((n, n)) < p, 1)
        linked |= linked.T
        compared = []

        def near(i, others, linked=linked, compared=compared):
            compared.append(len(others))
            return linked[i, others]

        got = {x: y for star in graph.contract((i, int(j)) for i, found in simhash.spread(n, near) for j in found) for x, y in star}
        want = {x: y for star in graph.contract(zip(*(c.tolist() for c in np.nonzero(linked)), strict=True)) for x, y in star}
        assert got == want
    assert sum(compared) < 200  # few comparisons in a dense group


def test_substring(spark, empty):
    random.seed(3)
    many = [(i, " ".join(random.choice(random.choice(["a", "ab", "abcdefghijk"])) for _ in range(random.choice([0, 20, 34, 35, 36, 60, 120])))) for i in range(120)]
    many += [*ODD, (None, " ".join(map(str, range(36)))), (303, " ".join(map(str, range(500, 540))) + " q " + " ".join(map(str, range(500, 540))))]
    assert rows(substring.strip_repeats(docs(spark, many)).drop("kept")) == brute.repeats(many)
    assert substring.strip_repeats(empty).count() == 0


def test_lines(spark, empty):
    random.seed(5)
    base = ["".join(random.choice("abc ") for _ in range(random.choice([20, 21, 24, 40, 90]))) for _ in range(20)] + ["a" * 20, "a" * 21, "ab" * 10]

    def mutate(x):
        for _ in range(random.choice([0, 1, 1, 2])):
            i = random.randrange(len(x))
            x = random.choice([x[:i] + x[i + 1 :], x[:i] + random.choice("abcé") + x[i:], x[:i] + random.choice("abcé") + x[i + 1 :]])
        return x

    many = [(i, "\n".join(mutate(random.choice(base)) for _ in range(random.randrange(6)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n\n"), (None, base[0])]
    digest = lambda df: rows(df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    assert digest(lines.dedup_lines(docs(spark, many))) == brute.lines(many)
    out = lines.dedup_lines(docs(spark).withColumn("n_lines", F.lit("mine")), counts=("a", "b"))
    assert lines.dedup_lines(empty).count() == 0 and out.count() == len(ODD) and {r.n_lines for r in out.collect()} == {"mine"}
    short = [(i, "\n".join(random.choice(["", " ", "ab"]) + "".join(random.choice("abé") for _ in range(random.randrange(8))) for _ in range(6))) for i in range(25)]
    assert digest(lines.dedup_lines(docs(spark, short))) == brute.lines(short)
    assert digest(lines.dedup_lines(docs(spark, short), similarity=1.0)) == brute.lines(short, least=None)


def test_short_lines(spark):
    many = [(1, "Les.\nab\n\n  \nLes.\nLet.\nabcde"), (2, "ab\n\nLes.\nac\n  \nabcdé\nabcd"), (3, "x" * 19 + "\n" + "x" * 20)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs(spark, many)).collect()}
    # One edit in four characters is below the similarity; blank lines stay.
    assert got == {1: ("Les.\nab\n\n  \nLet.\nabcde", 7, 1), 2: ("\nac\n  ", 7, 4), 3: ("x" * 19, 2, 1)}


def test_many_lines_of_one_document(spark):
    text = "\n".join(f"line {i % 20_000:05d} {'ab' * (i % 7)}" for i in range(60_000))
    r = lines.dedup_lines(docs(spark, [(1, text)]), similarity=1.0).first()
    assert r.n_lines == 60_000 and r.text == "\n".join(dict.fromkeys(text.split("\n")))


def test_sketch(spark, empty):
    """Against sets of shingles: what is kept is every shingle whose hash is below the fraction."""
    h, seen = WordHashes(), {}

    def brute_sketch(text, scale=sketch.SCALE):
        w = (text or "").encode().split()
        grams = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        for g in grams:
            if g not in seen:
                seen[g] = int(sketch.sketch(b" ".join(g), h, scale=1).hashes[0])
        all_hashes = sorted({seen[g] for g in grams})
        return [x for x in all_hashes if x * scale < 1 << 64] or all_hashes[:1], {seen[g] for g in grams if seen[g] * scale < 1 << 64}

    many = [*ODD, (None, "x"), (None, "y"), *[(77, f"t{i} a b c d e") for i in range(40)]]
    signed = lambda t: (x := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (x >> 63 << 64)
    order = sorted(many, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = []
    for i, (a, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        (x, xs), (y, ys), (z, zs) = map(brute_sketch, (t, e, n))
        text = lambda q: "2:" + "".join(f"{v & 0xFFFFFFFF:08x}" for v in q)
        like = lambda p, ps, q, qs: len(ps & qs) / min(len(ps), len(qs)) if ps and qs else float(p == q)
        want.append((a, len(t), brute.sha(e), text(x), text(y), like(x, xs, y, ys), like(x, xs, z, zs)))
    for parts in (3, 12):  # with 12, quantiles fall on the repeated id
        assert rows(sketch.fingerprints(docs(spark, many), parts=parts)) == sorted(want, key=str)
    assert sketch.fingerprints(empty).count() == 0
    # Parts merge into the whole; containment of a part is close to 1 and that of the whole close to the part's share.
    ws = [f"t{i * 7919 % 100_003}" for i in range(20_000)]
    whole, a, b = (sketch.sketch(" ".join(x).encode(), h) for x in (ws, ws[:5004], ws[5000:]))
    assert a.merge(b).hashes.tolist() == whole.hashes.tolist()
    assert a.containment(whole) == 1 and abs(whole.containment(a) - 0.25) < 0.03


def test_sketch_keeps_one_fraction_of_every_text():
    h = WordHashes()
    sizes = [len(sketch.sketch(" ".join(f"a{i}b{n}" for i in range(n)).encode(), h).hashes) for n in range(104, 164)]
    assert all(0.3 * (n - 4) < s < 0.7 * (n - 4) for n, s in zip(range(104, 164), sizes, strict=True))
    words = [f"q{i * 31 % 4999}" for i in range(4999)]
    whole = sketch.sketch(" ".join(words).encode(), h)
    assert sum(sketch.sketch(" ".join(words[i : i + 14]).encode(), h).containment(whole) == 1 for i in range(0, 4800, 16)) >= 297


def test_memory_of_joined_ids():
    """A worker's arrays while it tokenises a batch of 16 MB stay below 60 MB."""
    coder = packing.WordIds(packing.vocabulary_path())
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 100] * 8000)], ["text"])
    tracemalloc.start()
    n = sum(len(coder.encode(part.column(0))[1]) - 1 for part in packing.slices(batch, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 and peak < 60_000_000


def test_packing(spark, empty):
    tok = packing._tokenizer(packing.vocabulary_path())
    odd = [*ODD, (50, "A<|endoftext|>b it's I'M \x1cx\x85y e\u0301 J\u030c. \u03a3, <|ENDOFTEXT|>.")]
    ids = Counter()
    stream = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in odd}
    got = packing.pack(docs(spark, odd)).collect()
    for r in got:
        piece = stream[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(stream[r.doc_id])
        ids[r.doc_id] += r.length
    assert all(ids[i] == len(stream[i]) * n for i, n in Counter(i for i, _ in odd).items())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    assert packing.pack(empty).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    hist = np.bincount(np.minimum(rng.geometric(0.002, 30_000), 4096), minlength=4097)
    found = packing.plan(hist)
    used = np.zeros_like(hist)
    for need, times in found:
        assert sum(need) <= 4096 and times > 0
        for v in need:
            used[v] += times
    assert (used == hist).all()
    n = sum(t for _, t in found)
    assert 1 - (hist * np.arange(4097)).sum() / (4096 * n) < 0.002
    combos = packing.combinations(hist, 4096)
    x = packing.solve_counts(combos, hist)
    assert (x >= 0).all() and x.sum() > 0.5 * n


def test_mixing(spark, empty):
    many = [(i, "w " * (i % 40)) for i in range(300)] + ODD
    got = mixing.mix(docs(spark, many), mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(many) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert None in by
    total = sum(r.size for r in got)
    order = sorted((s for s in by if s is not None)) + [None]
    caps = {s: 2.0 * sum(r.size for r in by[s]) for s in by}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # Clamp and reshare until no source is above its cap.
    fixed, goal = set(), {}
    while True:
        rest = 1.5 * total - sum(caps[s] for s in fixed)
        goal = {s: caps[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in by if x not in fixed) for s in by}
        over = {s for s in by if s not in fixed and goal[s] > caps[s]}
        if not over:
            break
        fixed |= over
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(goal[s]) and abs(sum(r.taken for r in rs) - goal[s]) < 1.0001
    mixed = mixing.repeated(docs(spark, many))
    assert mixed.columns == docs(spark).columns and mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0


def test_urls(spark):
    links = '<a href="https://b.zz/x"><a href=\'//c.zz\'><a href="/own">'
    pages = [(1, "https://A.example.COM/en/700?q", links), (2, "http://x.net/de/8", None), (3, "http://m.example.net/de/8#t", ""), (4, None, links), (5, "no scheme", ""), (6, "http://a.org/es/", '<a href="http://b.zz">'), (7, "http://a.org/es/2", ""), (8, "http://b.zz/q", '<a href="http://a.org/z">'), (9, "http://c.zz", ""), (9, "http://c.zz", ""), (10, "http://notcom/en/", ""), (11, "x://com/en/", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.judge(df, tolerance=1e-5).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5, 6, 10, 11)] == [
        ("a.example.com", "/en/700", "example.com/en/7", "allow"), ("x.net", "/de/8", "net/de/", "allow"), ("m.example.net", "/de/8", "example.net/de/8", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.org", "/es/", "org/es/", "block"), ("notcom", "/en/", None, "allow"), ("com", "/en/", "com/en/", "block")]
    # b.zz links to the blocked a.org and is linked from the trusted host, with half of its links each.
    score = {"trust": {}, "distrust": {}}
    for kind, seed, edges in (("trust", {"a.example.com": 0.5, "x.net": 0.5}, {"a.example.com": {"b.zz": 0.5, "c.zz": 0.5}, "a.org": {"b.zz": 1}, "b.zz": {"a.org": 1}}), ("distrust", {"m.example.net": 1 / 3, "a.org": 1 / 3, "com": 1 / 3}, {"b.zz": {"a.example.com": 0.5, "a.org": 0.5}, "c.zz": {"a.example.com": 1}, "a.org": {"b.zz": 1}})):
        p = dict(seed)
        for _ in range(200):
            new = {}
            for src, out in edges.items():
                for dst, share in out.items():
                    new[dst] = new.get(dst, 0) + 0.85 * p.get(src, 0) * share
            left = 1 - sum(new.values())
            for h, s in seed.items():
                new[h] = new.get(h, 0) + left * s
            p = new
        score[kind] = p
    for i, host in ((8, "b.zz"), (9, "c.zz")):
        assert got[i].trust == pytest.approx(score["trust"].get(host, 0), abs=1e-4) and got[i].distrust == pytest.approx(score["distrust"].get(host, 0), abs=1e-4)
    assert got[8].verdict == ("block" if score["distrust"]["b.zz"] > 0.5 * (score["trust"]["b.zz"] + score["distrust"]["b.zz"]) else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules=(), tolerance=0.1).collect()} == {"allow"} and {r.verdict for r in url_filter.judge(df, rules=(("com/", "block"),), tolerance=0.1).collect()} == {"allow", "block"}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    want = con.sql(url_filter.oracle()).fetchall()
    assert rows(url_filter.judge(df, tolerance=1e-3).select("page_id", "host", "path", "rule", "verdict")) == sorted(want, key=str)
    long = spark.createDataFrame([(1, "http://a.zz", "x" * 300_000 + '<a href="http://x.com/en/">' * 3000), (2, "http://x.com/en/", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge(long, tolerance=0.1).collect()) == [(1, "block"), (2, "block")]


def labelled(spark, n=600):
    random.seed(8)
    good = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "re", "ti", "mo", "ka", "du")]
    out = []
    for i in range(n):
        words = [random.choice(good) for _ in range(random.randrange(5, 60))]
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            words[random.randrange(len(words))] = random.choice(["zorgface", "you zorghead", "idiot", "zorgling"])
        out.append((i, " ".join(w + "%%%" if poor else w for w in words), "en", f"s{i % 4}", len(words) * 5, int(toxic), int(not poor)))
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, toxic int, quality int")
    return df.drop("toxic", "quality"), df.select("doc_id", "toxic", "quality")


def test_toxicity(spark):
    df, known = labelled(spark)
    more = df.unionByName(spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "x", 0), (5000, "", "en", "x", 0)], df.schema))
    more = more.unionByName(spark.createDataFrame([(5001, LONG + " zorgface", "en", "x", 0)], df.schema))
    clashing = more.withColumns({c: F.lit("mine") for c in ("score", "predicted", "held_out", "t_score", "c0")})
    got = toxicity.score(clashing, known).collect()
    assert len(got) == 604
    kept = toxicity.non_toxic(clashing, known)
    assert kept.columns == clashing.columns and {r.predicted for r in kept.collect()} == {"mine"} and kept.count() == sum(r.predicted == 0 for r in got)
    truth = {r.doc_id: r.toxic for r in known.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.97
    none = toxicity.score(df, known.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0 and toxicity.score(df.limit(0), known).count() == 0


def test_quality(spark):
    df, known = labelled(spark)
    odd = [(None, None, None, None, None), (5000, "", "en", "x", 0), (5000, "", "en", "x", 0), (5001, LONG, None, "new", None)]
    more = df.unionByName(spark.createDataFrame(odd, df.schema)).withColumns({c: F.lit("mine") for c in ("score", "label", "row", "tie", "fold", "t", "keep")})
    got = cotrain.score(more, known, held_out=toxicity.held_out).collect()
    truth = {r.doc_id: r.quality for r in known.collect()}
    out = [(r.keep, truth[r.doc_id] == 1) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == 604 and sum(a == b for a, b in out) / len(out) > 0.97
    assert cotrain.score(df, known.where("quality = 1")).where("keep").count() == 600


def test_capitals_of_the_whole_text():
    for text in ("", "aB", "aB" * 1500, "ÄäÉ ǅΣσ" * 700, ("A" + "b" * 499) * 2000):
        assert cotrain.text_features(text)[8] == sum(c.isupper() for c in text) / max(1, len(text))


def test_many_sources_count():
    """Every source of the labelled rows has a rate of its own, however many there are."""
    values = [f"s{i % 3000}" for i in range(12_000)]
    y = np.array([int(v[1:]) % 2 for v in values])
    rates = cotrain.Rates(values, y)
    assert all((rates(f"s{i}")[0] > 0) == (i % 2 == 1) for i in range(3000)) and rates(None) == rates.unknown


def test_cotraining_teaches_the_other_view():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    a, b = y[:, None] + rng.normal(0, 0.3, (900, 2)), y[:, None] + rng.normal(0, 0.3, (900, 2))
    fold = np.arange(60) % 3

    def propose(views, most, given):
        for me, x in enumerate((a, b)):
            p = views[me].predict(x[60:500])
            for label, at in ((1, np.flatnonzero(p >= 0.95)), (0, np.flatnonzero(p <= 0.05))):
                for i in at.tolist():
                    yield me, label, i, a[60 + i], b[60 + i]

    v1, v2, both, taught = cotrain.cotrain(a[:60], b[:60], y[:60], fold, propose)
    assert taught and sum(taught[0]) > 20 and sum(taught[0]) <= 2 * 60
    p = both.predict(np.column_stack([models.logit(v1.predict(a[500:])), models.logit(v2.predict(b[500:]))]))
    assert ((p > 0.5) == y[500:]).mean() > 0.95


def test_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    assert ((models.BoostedTrees().fit(x[:1000], y[:1000]).predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    s = rng.random(500)
    iso = models.Isotonic().fit(s, (rng.random(500) < s).astype(float))
    grid = iso.predict(np.linspace(0, 1, 50))
    assert (np.diff(grid) >= 0).all() and abs(grid - np.linspace(0, 1, 50)).mean() < 0.12
