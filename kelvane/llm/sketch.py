"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle that is below a fixed fraction of all hashes, the same for every text. Sketches of two parts of
a text merge into that of the whole, and shares of common hashes estimate how much of one text another contains, however
unequal they are. A text none of whose hashes is below the fraction keeps its smallest one, so that its fingerprint still is its own; that hash
merges like the others, and estimates don't use it. A text without words has the hash of no words.

The fraction 1 / ``scale`` is 1/2: of a passage of 14 words (10 shingles) nothing is kept in one case of 1,000, with 1/8 in one of 4. Where all texts are long,
a smaller fraction does.

Fingerprint: ``<scale>:<kept hashes, ascending, 8 hex digits each>``. The 32 bits kept are the hash's lower ones; its
upper ones decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import bounded_batches, read
from kelvane.llm.words import Rolling, WordHashes, mix64

SHINGLE_WORDS, SCALE = 5, 2


class Sketch:
    """scale k and distinct 64-bit hashes, ascending: those below 2 ** 64 / k, or else the smallest."""

    __slots__ = ("scale", "hashes")

    def __init__(self, scale: int, hashes: np.ndarray):
        """hashes: distinct and ascending, of which the sketch keeps its part."""
        self.scale, self.hashes = scale, hashes[: max(1, self.below(scale, hashes))]

    @staticmethod
    def below(scale: int, hashes: np.ndarray) -> int:
        return int(np.searchsorted(hashes, np.uint64(-(-(1 << 64) // scale) - 1), "right")) if scale > 1 else len(hashes)

    def at(self, scale: int) -> np.ndarray:
        return self.hashes[: self.below(scale, self.hashes)]

    def merge(self, other: Sketch) -> Sketch:
        return Sketch(max(self.scale, other.scale), np.union1d(self.hashes, other.hashes))

    def _shared(self, other: Sketch) -> tuple[int, int, int]:
        scale = max(self.scale, other.scale)
        a, b = self.at(scale), other.at(scale)
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def containment(self, other: Sketch) -> float:
        """Share of this sketch's hashes that the other has; 1 for equal sketches, 0 where there is none to compare."""
        both, own, _ = self._shared(other)
        return both / own if own else float(np.array_equal(self.hashes, other.hashes))

    def likeness(self, other: Sketch) -> float:
        """Share of the smaller sketch that the larger has; 1 for equal sketches; 0 where nothing is left to compare."""
        both, own, others = self._shared(other)
        return both / min(own, others) if own and others else float(np.array_equal(self.hashes, other.hashes))

    def __str__(self) -> str:
        return f"{self.scale}:{(self.hashes & np.uint64(0xFFFFFFFF)).astype('>u4').tobytes().hex()}"


def sketch(text: bytes, hashes: WordHashes, k: int = SHINGLE_WORDS, scale: int = SCALE) -> Sketch:
    words = hashes(text.split())
    at = np.arange(max(1, len(words) - k + 1))
    return Sketch(scale, np.unique(mix64(Rolling(words).runs(at, at + min(k, len(words))))))


def with_next(docs: DataFrame, parts: int, text: str = "text") -> DataFrame:
    """(b, d, t, ghost, doc_id, text): rows in buckets of ascending (doc_id, hash t of the text); each bucket ends with a ghost, the first row of the next one.

    Bounds are quantiles of the ids; an id that several quantiles fall on has as many buckets more, by t. Only one id per bucket reaches the driver. The
    last bucket's ghost is the first row of all.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(own).alias("t"), own.alias("text"))
    ids = rows.select("d", "t")
    found = [int(c) for c in ids.approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    cuts, often = np.unique(np.array(found, np.int64), return_counts=True)
    more = np.append(np.where(often > 1, often, 0), 0)
    first_of = np.cumsum(1 + more) - (1 + more)

    def bucket(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        at = np.searchsorted(cuts, d)
        hot = more[at] * (np.append(cuts, 0)[at] == d)
        part = ((t.astype(np.float64) / 2.0**64 + 0.5) * hot).astype(np.int64)  # floors, as it is not negative
        return (first_of[at] + np.where(hot > 0, 1 + np.minimum(part, hot - 1), 0)).astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket(d, t)), batch.column(0), batch.column(1)], ["b", "d", "t"])

    first = {r["b"]: (r["s"]["d"], r["s"]["t"]) for r in ids.mapInArrow(number, "b int, d long, t long").groupBy("b").agg(F.min(F.struct("d", "t")).alias("s")).collect()}  # a row per bucket
    order = sorted(first)
    ghost_of = {first[b]: order[i - 1] for i, b in enumerate(order)}
    ghost_ids = np.array(sorted({d for d, _ in ghost_of}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            some = np.flatnonzero(ghost_ids[np.minimum(np.searchsorted(ghost_ids, d), len(ghost_ids) - 1)] == d).tolist()
            twice = [(i, ghost_of[key]) for i in some if (key := (int(d[i]), int(t[i]))) in ghost_of]
            again = batch.take(pa.array([i for i, _ in twice], pa.int64()))
            for b, g, rows in ((pa.array(bucket(d, t)), False, batch), (pa.array([b for _, b in twice], pa.int32()), True, again)):
                yield pa.RecordBatch.from_arrays([b, rows.column(0), rows.column(1), pa.array([g] * len(rows), pa.bool_()), rows.column(2), rows.column(3)], ["b", "d", "t", "ghost", "doc_id", "text"])

    return rows.select("d", "t", "doc_id", "text").mapInArrow(deal, "b int, d long, t long, ghost boolean, doc_id long, text string")


def edited(text: str, following: str) -> str:
    """The text with its last n // 2 code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, *, k: int = SHINGLE_WORDS, scale: int = SCALE, text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is that of the next larger doc_id (rows of one doc_id: in the order of a hash of their texts), after the last the first; a
    single document follows itself. Null text counts as empty; a null doc_id comes first. Rows that repeat doc_id and text follow each other. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_next(docs, parts, text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = lambda t: sketch(t.encode(), hashes, k, scale)
        held = None
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for b, ghost, doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                now = (b, ghost, doc_id, t := t.as_py(), own(t))
                if held and held[0] == b and not held[1]:
                    changed = edited(held[3], t)
                    other = own(changed)
                    mine = held[4]
                    for c, x in zip(cols, (held[2], len(held[3]), hashlib.sha256(changed.encode()).hexdigest(), str(mine), str(other), mine.likeness(other), mine.likeness(now[4])), strict=True):
                        c.append(x)
                held = now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    ordered = dealt.repartition(parts, "b").sortWithinPartitions("b", "ghost", "d", "t", "text").select("b", "ghost", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
