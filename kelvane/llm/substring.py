"""Substring dedup by seed and extend.

Seeds: of the hashes of ``seed_words`` consecutive words that start in a window, the smallest (winnowing). Equal windows
have equal seeds at equal places, so windows can be equal only where documents join on a seed. The windows that share
an occurrence of a seed form a run of starts; the words that they cover are its span, the furthest that the seed extends
to the left and to the right with this seed as smallest.

Extension goes from the whole to the part. Occurrences of a seed with equal spans repeat in full: all their
windows do, however many there are, and one of them goes on for the rest. Only where one seed has different spans, at the
edges of shared passages, are the single windows of one occurrence per span extended and compared. Marked starts of a
document come together as maximal repeats when their windows are joined.

So nothing is listed pair by pair: a passage in n documents costs n rows. A seed that occurs very often is counted by
partial aggregation, and its rows meet one row in a join that AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read
from kelvane.llm.words import Rolling, WordHashes, window_min

#: Window, words of a seed, and words whose hashes a worker keeps.
WINDOW, SEED_WORDS, WORDS = 35, 8, 150_000

_PLACE = np.uint64((1 << 30) - 1)
_OTHER_BASE = 0xD6E8FEB86659FD93


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: at the six white-space bytes only


def seed_runs(words: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, seed, span) of each run of window starts with one occurrence of a seed.

    Of seeds that are equally small (by their upper bits) the last counts, so that its place within a window depends on the
    window's words only, and a run has at most ``window - seed_words + 1`` starts.
    """
    width = window - seed_words + 1
    at = np.arange(len(words) - seed_words + 1)
    rolling = Rolling(words)
    grams = rolling.runs(at, at + seed_words)
    place = (_PLACE - (window_min(grams & ~_PLACE | _PLACE - at.astype(np.uint64), width) & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(first, len(place)))
    return first, n, grams[place[first]], rolling.runs(first, first + n + window - 1)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Rows by doc_id and a hash of the text, which keeps apart different texts of one doc_id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))


def _seeds(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = WordHashes(WORDS), ["d", "h", "start", "n", "seed", "span"]
        for batch in batches:
            held, size = [], 0
            for d, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _split(text.as_py())
                if len(words) < window:
                    continue
                first, n, seed, span = seed_runs(hashes(words), window, seed_words)
                held.append((np.full(len(n), d), np.full(len(n), h), first.astype(np.int32), n.astype(np.int32), seed.view(np.int64), span.view(np.int64)))
                size += len(n)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    return run


def _windows(window: int):
    """Text with its runs -> the single windows of each run, under two hashes of 64 bits that share no word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others, names = WordHashes(WORDS), WordHashes(WORDS, seed=1), ["seed", "span", "n", "i", "w1", "w2"]
        for batch in batches:
            for text, runs in zip(batch.column(0), batch.column(1), strict=True):
                split = _split(text.as_py())
                v = runs.values
                start, n, seed, span = (v.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "seed", "span"))
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(start, n) + inside
                w1, w2 = (Rolling(h(split), b).runs(at, at + window).view(np.int64) for h, b in ((hashes, 0x9E3779B97F4A7C15), (others, _OTHER_BASE)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(seed, n), np.repeat(span, n), np.repeat(n, n).astype(np.int32), inside.astype(np.int32), w1, w2)], names)

    return run


def removed(n_words: int, start: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by the windows that begin at start + i for the bits i of mask."""
    change = np.zeros(n_words + 1, np.int64)
    for i in range(int(mask.max()).bit_length() if len(mask) else 0):
        at = start[mask >> i & 1 == 1] + i
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change)[:n_words] > 0


def _strip(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                words, gone = _split(text.as_py()), 0
                n = len(words)
                if marks.is_valid:
                    v = marks.values
                    out = removed(n, v.field("start").to_numpy(zero_copy_only=False), v.field("mask").to_numpy(zero_copy_only=False), window)
                    gone = int(out.sum())
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                for c, x in zip(cols, (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def strip_repeats(docs: DataFrame, *, window: int = WINDOW, seed_words: int = SEED_WORDS, text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: each row's words that no repeated window covers, joined by one space.

    A window is ``window`` consecutive words of one row; it is repeated if its words also start anywhere else. Null and empty texts have no
    words; rows that are repeated repeat each other; rows of one doc_id with different texts are kept apart. An empty table gives an empty
    result; other columns are ignored. ``texts=False`` leaves ``kept`` null. Windows of one seed are marked in 64 bits, so ``seed_words``
    is at least ``window - 61``.
    """
    if not 0 <= window - seed_words <= 61:
        raise ValueError("seed_words must be from window - 61 to window")
    scratch = Scratch(docs.sparkSession)
    rows = _keyed(docs, text)
    seeds = scratch.keep(rows.mapInArrow(_seeds(window, seed_words), "d long, h long, start int, n int, seed long, span long"))
    again = scratch.keep(seeds.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed"))  # written, so that AQE can split a common seed
    found = scratch.keep(seeds.join(again, "seed"))
    scratch.drop(seeds)
    spans = scratch.keep(found.groupBy("seed", "span", "n").agg(F.count("*").alias("c"), F.min(F.struct("d", "h", "start")).alias("one")))
    edges = spans.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed")
    single = spans.join(edges, "seed").select("one.*", "seed", "span", "n")
    by_doc = single.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n", "seed", "span")).alias("runs"))  # at most a document's own runs
    # A row that occurs twice gives its windows twice; they are repeats, as its spans' counts say already.
    windows = scratch.keep(rows.join(by_doc, ["d", "h"]).select("text", "runs").mapInArrow(_windows(window), "seed long, span long, n int, i int, w1 long, w2 long"))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    part = windows.join(twice, ["w1", "w2"]).groupBy("seed", "span", "n").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("part_mask"))
    mask = scratch.keep(spans.join(part, ["seed", "span", "n"], "left").select("seed", "span", "n", F.when(F.col("c") > 1, F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("part_mask")).alias("mask")).where("mask is not null"))  # written, so that AQE can split a common span below
    marks = found.join(mask, ["seed", "span", "n"]).groupBy("d", "h").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))  # at most a document's own runs
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return rows.join(marks, ["d", "h"], "left").select(F.expr(f"nullif(d, {-(1 << 63) + 1} - 1)").alias("doc_id"), "text", "marks").mapInArrow(_strip(window, texts), kinds)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(read(spark, sf_dir, "documents"), texts=False).drop("kept")
