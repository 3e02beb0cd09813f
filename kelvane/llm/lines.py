"""Line dedup by a deletion-neighbourhood join: of lines within one edit of each other, the earliest stays.

Lines with an equal variant, which is the line itself or the line without one character, are joined: equal lengths without the same
place differ by a substitution, and a line that equals a longer one without some character differs by an insertion. In a group of one
variant only the earliest line matters to all others, so groups give one candidate per member and never pairs; each
candidate's edit distance is then verified on the texts.

A line of n characters has n variants, which would be as many rows as the corpus has characters. So places that cannot
matter are left out first, without loss: lines within one edit agree on all but one of any p blocks. Keys of "all but one block"
are counted for two blocks, taken while reading, and for 16 blocks, for what is left; variants are made only in the
blocks whose key another line has.

All of it are DataFrame functions. Skew: a very common line is one distinct line after partial aggregation; its occurrences meet one
row in a join that AQE can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, WORD, read

#: An edit in a line of n characters leaves a similarity of 1 - 1 / n.
SIMILARITY, BLOCKS = 0.8, 16
_LAST = (1 << 63) - 1


def without_block(line: Column, length: Column, base: Column, start: Column, stop: Column, *more: Column) -> Column:
    """Hash of a line without the places start .. stop of a line of ``base`` characters; of a line one longer, one place more goes."""
    return F.xxhash64(*more, base, F.substring(line, F.lit(1), start), F.substring(line, length - base + stop + 1, base - stop))


def coarse_keys(line: Column, length: Column) -> list[Column]:
    """Hashes of all but either half, for comparison with lines as long or one longer, and with lines one shorter."""
    zero = F.lit(0)
    out = []
    for base in (length, length - 1):
        half = F.floor(base / 2).cast("int")
        out += [without_block(line, length, base, zero, half, F.lit(0)), without_block(line, length, base, half, base, F.lit(1))]
    return out


def exploded(rows: DataFrame) -> DataFrame:
    """(d, h, text) -> (d, h, i, line, l1, l2) of the lines with a word; l1 and l2 are hashes of the line."""
    lines = rows.select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.col("line").rlike(WORD))
    return lines.select("d", "h", "i", "line", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"))


def near_lines(lines: DataFrame, rows: DataFrame, scratch: Scratch, least: int, blocks: int = BLOCKS) -> DataFrame:
    """(l1, l2) of the distinct lines that have an earlier line within one edit, the longer of the two of ``least`` characters or more.

    lines: (l1, l2, first struct<d,h,i>, k0 .. k3 or null), one row per distinct line; rows: (d, h, text), where their texts are.
    """
    key = lines.where("k0 is not null").select("l1", "l2", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = key.join(shared, "key").select("l1", "l2").distinct()
    wanted = lines.join(left, ["l1", "l2"]).select("first.*")
    texts = scratch.keep(exploded(rows).join(wanted, ["d", "h", "i"]).dropDuplicates(["l1", "l2"]).withColumn("n", F.length("line")))

    longer, j = F.floor(F.col("x") / blocks).cast("int"), F.col("x") % blocks
    base = F.col("n") - longer
    start, stop = F.floor(j * base / blocks).cast("int"), F.floor((j + 1) * base / blocks).cast("int")
    cut = texts.select("l1", "l2", "line", "n", F.explode(F.sequence(F.lit(0), F.lit(2 * blocks - 1))).alias("x")).where(start < stop)
    fine = scratch.keep(cut.select("l1", "l2", F.col("x").cast("byte").alias("x"), without_block(F.col("line"), F.col("n"), base, start, stop, j).alias("key")))
    shared = fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    ranges = fine.join(shared, "key").select("l1", "l2", F.col("x").cast("int").alias("x"))

    # kind 0: equal lengths without the same place; 1: a line as it is, and 2: one without a place, which may be the same text.
    places = texts.join(ranges, ["l1", "l2"]).select("d", "h", "i", "l1", "l2", "line", longer.alias("longer"), F.explode(F.sequence(start, stop + longer - 1)).alias("p"))
    short = F.concat(F.substring("line", F.lit(1), F.col("p")), F.substring(F.col("line"), F.col("p") + 2, F.length("line")))
    whole = lambda t: F.xxhash64(F.lit(-1), t)
    me = ["d", "h", "i", "l1", "l2"]
    cuts = places.select(F.when(F.col("longer") == 1, whole(short)).otherwise(F.xxhash64("p", short)).alias("v"), (2 * F.col("longer")).alias("kind"), *me)
    own = texts.join(ranges.select("l1", "l2").distinct(), ["l1", "l2"]).select(whole(F.col("line")).alias("v"), F.lit(1).alias("kind"), *me)
    variants = scratch.keep(cuts.unionByName(own))
    scratch.drop(fine)
    least_of = variants.groupBy("v", "kind").agg(F.min(F.struct(*me)).alias("w"))
    # Lines as they are meet lines without a place, and the other way round.
    meets = least_of.select("v", F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind")).alias("kind"), "w")
    pairs = variants.join(meets, ["v", "kind"]).where(F.col("w") < F.struct(*me)).select("l1", "l2", F.col("w.l1").alias("m1"), F.col("w.l2").alias("m2")).distinct()
    a, b = texts.select("l1", "l2", F.col("line").alias("line_a")), texts.select(F.col("l1").alias("m1"), F.col("l2").alias("m2"), F.col("line").alias("line_b"))
    near = F.levenshtein("line_a", "line_b", 1).between(0, 1) & (F.greatest(F.length("line_a"), F.length("line_b")) >= least)
    return scratch.keep(pairs.join(a, ["l1", "l2"]).join(b, ["m1", "m2"]).where(near).select("l1", "l2").distinct())


def dedup_lines(docs: DataFrame, *, similarity: float = SIMILARITY, blocks: int = BLOCKS, text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The columns of ``docs`` with the text's repeated lines removed, then two counts of lines under the names ``counts``.

    Lines end at line feeds. A line with a word goes if an earlier line, by doc_id and then place, equals it, or is within one edit (insertion, deletion or
    substitution of a code point) of it with a similarity of 1 - 1 / (characters of the longer) of ``similarity`` or more, whether or not that line stays itself;
    0.8 asks for five characters. Similarity 1 leaves equal lines only. Lines without a word always stay.
    Null text stays null and has no lines; a null doc_id comes last; rows that repeat doc_id and text count as one row and all stay alike; rows of
    one doc_id with different texts are ordered by a hash. An empty table gives an empty result; other columns are carried through, but those
    named as the counts, which take their places.
    """
    scratch = Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c != text and c not in counts]
    carried = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    own = F.col(f"`{text}`")
    keyed = docs.select(carried, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.coalesce(F.xxhash64(own), F.lit(0)).alias("h"), F.split(own, "\n", -1).alias("parts"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.coalesce(F.xxhash64(own), F.lit(0)).alias("h"), own.alias("text"))
    least = math.ceil(1 / (1 - similarity) - 1e-9) if similarity < 1 else None
    keys = [F.when(F.length("line") >= least - 1, k) if least else F.lit(None).cast("long") for k in coarse_keys(F.col("line"), F.length("line"))]
    seen = scratch.keep(exploded(rows).select("d", "h", "i", "l1", "l2", *[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    lines = scratch.keep(seen.groupBy("l1", "l2").agg(F.min(F.struct("d", "h", "i")).alias("first"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)]))
    state = lines.select("l1", "l2", "first", F.lit(None).cast("boolean").alias("near"))
    if least:
        near = near_lines(lines, rows, scratch, least, blocks).withColumn("near", F.lit(True))
        state = lines.select("l1", "l2", "first").join(near, ["l1", "l2"], "left")
    gone = seen.select("d", "h", "i", "l1", "l2").join(state, ["l1", "l2"]).where(F.col("near").isNotNull() | (F.struct("d", "h", "i") != F.col("first")))
    per = gone.groupBy("d", "h").agg(F.collect_set("i").alias("gone"))  # at most a document's own lines
    out = keyed.join(per, ["d", "h"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("parts")).otherwise(F.transform(stay, lambda i: F.element_at("parts", i + 1))), "\n")
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text: kept}
    return out.select(
        *[at[c].alias(c) for c in docs.columns if c in at],
        F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias(counts[0]), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias(counts[1]),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
