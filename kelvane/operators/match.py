"""Entity resolution: candidates against known entities by domain, by normalised name, then by similarity.

Indexes are aggregations (the first known entity wins), probes are joins, and only what a stage leaves open reaches the
next one. Spark broadcasts an index where its size allows; nothing is hinted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvane.config import FUZZY_THRESHOLD
from kelvane.functions import text as X
from kelvane.functions.similarity import ratio, with_domain_fit
from kelvane.operators.components import connected
from kelvane.sources.store import ensure_checkpoint_dir

# The reasons that results carry.
SAME_NAME = "identischer Name (normalisiert)"
NO_NAME = "leerer Firmenname"
IN_BATCH = ("(innerhalb dieses Laufs)", "doppelt im Kandidatensatz")


def known_entities(master: DataFrame, model) -> DataFrame:
    """(pos, name, url): rows with an address in row order, then all distinct names by first row."""
    from kelvane.operators.blocks import entity_names, named_urls

    urls = named_urls(master, model).select(F.struct(F.lit(0), "row_idx").alias("pos"), "name", "url")
    names = entity_names(master, model).select(F.struct(F.lit(1), "row_idx").alias("pos"), "name", F.lit("").alias("url"))
    return urls.unionByName(names)


def domain_index(known: DataFrame) -> DataFrame:
    """(domain, d_name): the first known name of each domain that plausibly belongs to its name."""
    rows = known.where(~X.is_blank(F.col("name"))).withColumn("domain", X.registrable_domain(F.col("url"))).where("domain != ''")
    return with_domain_fit(rows, "domain", "name").where("fits").groupBy("domain").agg(F.min_by(X.strip(F.col("name")), "pos").alias("d_name"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to two tasks a core by ``keys``. Names are few bytes and much work, so that by size AQE would leave them to one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def name_index(known: DataFrame) -> DataFrame:
    """(norm, n_name, n_pos): the first known name of each normalised name. A name that rows repeat is normalised once."""
    rows = spread(known.groupBy("name").agg(F.min("pos").alias("pos")), "name").where(~X.is_blank(F.col("name")))
    rows = rows.withColumn("norm", X.normalize_company(F.col("name"))).where("norm != ''")
    return rows.groupBy("norm").agg(F.min_by(X.strip(F.col("name")), "pos").alias("n_name"), F.min("pos").alias("n_pos"))


#: A first character's candidates are dealt to so many parts, each with its known names.
SALTS = 32
#: Characters that normalised names consist of.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 &+-"
#: A mark takes four bits, so that a long has those of 16 characters.
_LONGS = [_ALPHABET[at : at + 16] for at in range(0, len(_ALPHABET), 16)]


def _letters(norm: str) -> Column:
    """A set of marks of a column: of each character's first four occurrences one bit each; n is the length.

    One SQL text, since thousands of Column objects take seconds to build.
    """
    count = "length({0}) - length(translate({0}, '{1}', ''))"
    mark = f"shiftleft(shiftleft(1L, least({count}, 4)) - 1L, {{2}})"
    longs = [" | ".join(mark.format(norm, c, 4 * i) for i, c in enumerate(part)) for part in _LONGS]
    return F.expr(f"struct({', '.join(f'{v} AS l{i}' for i, v in enumerate(longs))}, length({norm}) AS n)")


def shared_bound(a: str, b: str) -> Column:
    """What the ratio of two names cannot exceed, by their marks: both have to have a matched character.

    Characters without a mark, from the fifth occurrence on or of another alphabet, may all match.
    """
    shared = " + ".join(f"bit_count({a}.l{i} & {b}.l{i})" for i in range(len(_LONGS)))
    more = ["{0}.n - {1}".format(x, " - ".join(f"bit_count({x}.l{i})" for i in range(len(_LONGS)))) for x in (a, b)]
    return F.expr(f"2 * ({shared} + least({more[0]}, {more[1]})) / greatest({a}.n + {b}.n, 1)")


#: Below this threshold segments could be empty, and all pairs are compared.
LEAST_SEGMENTED = 0.8
#: Edits (insertions and deletions) that the first rounds look for; the last one looks for as many as the threshold admits.
ROUNDS = (1, 3, None)


def _segmented(left: DataFrame, right: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c_norm, k_norm, n_name, n_pos): all pairs that ``most`` insertions and deletions or fewer part, and others. lengths: (la, lb, most).

    most is as much as the lengths differ, or an even number more. The known name is cut into one segment more than most, and each edit is counted to one of them.
    Let i be the last segment with at least i edits before it: it has exactly i before it and none in it, since with the next one there are fewer than i + 1. So some
    segment i stands in the candidate, moved by s places that i edits can make (at most i, and even if i is), and at most most - i edits make up for the rest.
    """
    cut = lambda i: f"cast({i} * lb div (most + 1) as int)"
    segment = lambda norm, shift: f"xxhash64(ch, lb, most, i, substring({norm}, {cut('i')} + 1 + {shift}, {cut('(i + 1)')} - {cut('i')}))"
    parts, places = F.explode(F.expr("sequence(0, most)")), F.explode(F.expr("sequence(greatest(-i, la - lb - most + i), least(i, la - lb + most - i), 2)"))
    probes = left.join(F.broadcast(lengths), "la").withColumn("i", parts).withColumn("s", places)
    probes = probes.where(f"{cut('i')} + s >= 0 and {cut('(i + 1)')} + s <= la").select("c_norm", "ch", "lb", "most", F.expr(segment("c_norm", "s")).alias("segment"))
    kinds = lengths.select("lb", "most").distinct()
    segments = right.join(F.broadcast(kinds), "lb").withColumn("i", parts)
    segments = segments.select("k_norm", "n_name", "n_pos", F.col("ch").alias("k_ch"), F.col("lb").alias("k_lb"), F.expr(segment("k_norm", "0")).alias("segment"))
    # Merged, since the sizes that Spark knows are those before the names were cut.
    met = probes.join(segments.hint("merge"), "segment").where("ch = k_ch and lb = k_lb and levenshtein(c_norm, k_norm) <= most")
    return spread(met.select("c_norm", "k_norm", "n_name", "n_pos"), "c_norm", "k_norm").dropDuplicates(["c_norm", "k_norm"])


def _best(pairs: DataFrame) -> DataFrame:
    """(c_norm, f_score, f_name): each candidate's best pair, the first known of equal ones."""
    scored = pairs.withColumn("score", ratio(F.col("c_norm"), F.col("k_norm")))  # a filter on it would go below the join, to all pairs
    return scored.groupBy("c_norm").agg(F.max("score").alias("f_score"), F.min_by("n_name", F.struct((-F.col("score")).alias("s"), "n_pos")).alias("f_name"))


def _all_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The pairs with a bound of at least ``least`` and of what the candidate's pair of the fewest edits scores, which no better pair can miss."""
    dealt = left.select("c_norm", "ch", F.pmod(F.xxhash64("c_norm"), F.lit(SALTS)).cast("int").alias("salt"), _letters("c_norm").alias("c"))
    known = right.select("k_norm", "n_name", "n_pos", "ch", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), _letters("k_norm").alias("k"))
    pairs = dealt.repartition(SALTS, "ch", "salt").join(known, ["ch", "salt"]).select("c_norm", "k_norm", "n_name", "n_pos", shared_bound("c", "k").alias("bound")).where(F.col("bound") >= least)
    first = pairs.groupBy("c_norm").agg(F.min_by("k_norm", F.levenshtein("c_norm", "k_norm")).alias("k_norm"))
    reached = first.select(F.col("c_norm").alias("r_norm"), ratio(F.col("c_norm"), F.col("k_norm")).alias("reached"))
    return pairs.join(reached, F.col("c_norm") == F.col("r_norm")).where(F.col("bound") >= F.col("reached") - 1e-9)


def fuzzy(open_rows: DataFrame, names: DataFrame, key: str, threshold: float = FUZZY_THRESHOLD, exact_best: bool = False) -> DataFrame:
    """(key, f_name, f_score): the most similar known name with the same first character; ties go to the first known.

    Pairs are of distinct normalised names on both sides. Rounds of growing numbers of edits find all pairs of at least ``threshold`` by common segments; a candidate
    is settled when no pair still unseen can be as good as its best. With ``exact_best`` those without such a pair are compared with every name of their
    first character, else they are left out.
    """
    ensure_checkpoint_dir(open_rows.sparkSession)
    left = open_rows.select(F.col("norm").alias("c_norm")).distinct().select("c_norm", F.substring("c_norm", 1, 1).alias("ch"), F.length("c_norm").alias("la"))
    left = spread(left, "c_norm").checkpoint()
    right = spread(names.select(F.col("norm").alias("k_norm"), "n_name", "n_pos", F.substring("norm", 1, 1).alias("ch"), F.length("norm").alias("lb")), "k_norm").checkpoint()
    best = None
    if threshold >= LEAST_SEGMENTED:
        lengths = left.select("la").distinct().crossJoin(right.select("lb").distinct())
        lengths = lengths.withColumn("most", F.expr(f"cast(floor({1 - threshold!r}D * (la + lb) + 1e-9) as int)")).where("abs(la - lb) <= most").checkpoint()
    for edits in ROUNDS if threshold >= LEAST_SEGMENTED else ():
        most = f"least(most, {edits})" if edits else "most"
        found = _best(_segmented(left, right, lengths.select("la", "lb", F.expr(f"{most} - pmod({most} - la + lb, 2)").alias("most")).where("abs(la - lb) <= most"))).where(F.col("f_score") >= threshold)
        if edits:
            found = found.where(F.col("f_score") > F.expr(f"2D * length(c_norm) / (2 * length(c_norm) + {edits + 1})"))
        found = found.checkpoint()
        best = found if best is None else best.unionByName(found)
        if not edits and not exact_best:
            break
        left = spread(left.join(found, "c_norm", "left_anti"), "c_norm").checkpoint()
        if left.isEmpty():
            break
    if best is None or exact_best and not left.isEmpty():
        rest = _best(_all_pairs(left, right, 0.0 if exact_best else threshold)).where("f_score > 0")
        best = rest if best is None else best.unionByName(rest)
    return open_rows.select(key, "norm").join(best, F.col("norm") == F.col("c_norm")).select(key, "f_name", "f_score")


def match(candidates: DataFrame, known: DataFrame, *, key: str = "cand_idx", name: str = "name", url: str = "url", threshold: float = FUZZY_THRESHOLD, exact_best: bool = True) -> DataFrame:
    """Adds is_duplicate, matched_company, reason, score to the candidates.

    Domain first, then the normalised name, then similarity of at least ``threshold``. ``exact_best=False`` leaves out the best score
    of candidates without a match, which saves most comparisons.
    """
    ensure_checkpoint_dir(candidates.sparkSession)
    rows = spread(candidates, key).withColumn("domain", X.registrable_domain(F.col(url))).withColumn("norm", X.normalize_company(F.col(name)))
    names = name_index(known).checkpoint()
    probed = rows.join(domain_index(known), "domain", "left").join(names.select("norm", "n_name"), "norm", "left").checkpoint()
    still_open = probed.where(F.col("d_name").isNull() & F.col("n_name").isNull() & (F.col("norm") != ""))
    near = fuzzy(still_open, names, key, threshold, exact_best)
    out = probed.join(near, key, "left")
    by_domain, by_name = F.col("d_name").isNotNull(), F.col("n_name").isNotNull()
    close = F.coalesce(F.col("f_score") >= threshold, F.lit(False))
    best = F.coalesce("f_score", F.lit(0.0))
    text = F.format_string("%.2f", best)
    return out.select(
        *candidates.columns, "domain", "norm", (by_domain | by_name | close).alias("is_duplicate"),
        F.when(by_domain, F.col("d_name")).when(F.col("norm") == "", "").when(by_name, F.col("n_name")).otherwise(F.coalesce("f_name", F.lit(""))).alias("matched_company"),
        F.when(by_domain, F.concat(F.lit("gleiche Domain ("), "domain", F.lit(")"))).when(F.col("norm") == "", NO_NAME).when(by_name, SAME_NAME)
        .when(close, F.concat(F.lit("aehnlicher Name (Score "), text, F.lit(")"))).otherwise(F.concat(F.lit("kein Treffer (bester Score "), text, F.lit(")"))).alias("reason"),
        F.when(by_domain, 1.0).when(F.col("norm") == "", 0.0).when(by_name, 1.0).otherwise(best).alias("score"),
    )


def _greedy(key: str):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, fresh = set(), []
        for k, domain, name in sorted(zip(pdf[key], pdf["dk"], pdf["nk"], strict=True)):
            own = {x for x in (("d", domain), ("n", name)) if x[1] is not None}
            if not own & taken:
                taken |= own
                fresh.append(k)
        return pd.DataFrame({key: fresh})

    return decide


def fresh_ones(rows: DataFrame, key: str, rounds: int = 6) -> DataFrame:
    """(key, dk, nk) of the rows that a greedy pass in the order of ``key`` takes: those that share dk or nk (or null) with none taken before.

    In a round all rows are taken that are the first open ones of their dk and of their nk, and those that share one with them go; a key that very many
    share costs one round. Long chains of rows, each blocked by the one before, would take as many rounds as they are long. What ``rounds`` leave open
    is split into connected groups, and each is decided in order in one task, which holds its keys.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    open_rows, out = rows, []
    for _ in range(rounds):
        tagged = open_rows
        for k in ("dk", "nk"):
            low = open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(key).alias(f"{k}_low"))
            tagged = tagged.join(low, k, "left")
        tagged = tagged.withColumn("first", F.coalesce(F.col("dk_low") == F.col(key), F.lit(True)) & F.coalesce(F.col("nk_low") == F.col(key), F.lit(True))).select(key, "dk", "nk", "first").checkpoint()
        out.append(tagged.where("first").select(key, "dk", "nk"))
        rest = tagged.where("not first").select(key, "dk", "nk")
        for k in ("dk", "nk"):
            rest = rest.join(out[-1].where(F.col(k).isNotNull()).select(k), k, "left_anti")
        open_rows = rest.select(key, "dk", "nk").checkpoint()
        if open_rows.isEmpty():
            break
    else:
        pairs = [open_rows.join(open_rows.groupBy(k).agg(F.min(key).alias("b")), k).select(F.col(key).alias("a"), "b") for k in ("dk", "nk")]
        roots = connected(pairs[0].unionByName(pairs[1]))
        grouped = open_rows.join(roots, F.col(key) == F.col("node"), "left").withColumn("root", F.coalesce("root", key))
        taken = grouped.select("root", key, "dk", "nk").groupBy("root").applyInPandas(_greedy(key), f"{key} long")
        out.append(open_rows.join(taken, key, "left_semi").select(key, "dk", "nk"))
    frame = out[0]
    for o in out[1:]:
        frame = frame.unionByName(o)
    return frame


def partition(matched: DataFrame, *, key: str = "cand_idx", rounds: int = 6) -> DataFrame:
    """Adds is_fresh, duplicate_of, duplicate_reason to matched candidates: greedy in the order of ``key``, a unique long.

    Only fresh candidates reserve their domain and name for later ones; one that the index knows reserves nothing. Keys are compared by 128-bit digests.
    """
    digest = lambda c: F.when(F.col(c) != "", F.md5(F.col(c).cast("binary")))
    keyed = matched.select(key, digest("domain").alias("dk"), digest("norm").alias("nk"), "is_duplicate")
    taken = fresh_ones(keyed.where(~F.col("is_duplicate")).select(key, "dk", "nk"), key, rounds).checkpoint()
    decided = keyed
    for k in ("dk", "nk"):  # no two fresh ones share a key
        decided = decided.join(taken.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(key).alias(f"{k}_by")), k, "left")
    again = lambda k: F.coalesce(F.col(f"{k}_by") < F.col(key), F.lit(False))
    decided = decided.select(key, (again("dk") | again("nk")).alias("in_batch"))
    out = matched.join(decided, key)
    return out.select(
        *matched.columns, (~F.col("in_batch") & ~F.col("is_duplicate")).alias("is_fresh"),
        F.when(F.col("in_batch"), IN_BATCH[0]).when(F.col("is_duplicate"), F.col("matched_company")).alias("duplicate_of"),
        F.when(F.col("in_batch"), IN_BATCH[1]).when(F.col("is_duplicate"), F.col("reason")).alias("duplicate_reason"),
    )
