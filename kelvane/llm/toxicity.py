"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of lexicon hits, their nearness to second-person words, capitals, punctuation and obfuscation. The lexicon is
learned: words and word beginnings that labelled rows tie to the label. Its counts are summed in Spark by fold,
so that a training row's features come from a lexicon that has not seen its label; scoring uses the lexicon of all folds.

Bounds: at most ``sample`` labelled rows, chosen by a digest of doc_id and one for each doc_id, reach the driver, and the lexicon's entries are words of
these rows. Every document is scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read
from kelvane.llm.models import BoostedTrees, Constant, Isotonic

SAMPLE, FOLDS, THRESHOLD = 20_000, 3, 0.7
_WORD = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
_LEET = str.maketrans("013457@$!*", "oieastasi*")
_SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Counted with a small weight where labels have not taught otherwise.
SEEDS = frozenset("idiot idiots idiotic stupid moron morons moronic imbecile loser losers pathetic scum scumbag worthless trash vermin disgusting dumb dumbass filthy bastard bitch asshole fuck fucking fucker shit retard cunt whore slut".split())
_NEAR, _SEED_WEIGHT = 5, 2.0
N_FEATURES = 19


def terms_of(word: str) -> list[str]:
    """What the lexicon may hold of a lower-case word: itself and its beginnings of 4, 5 and 6 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


def plain(word: str) -> str:
    """The word with look-alike signs turned to letters."""
    return word if word.isalpha() else "".join(c for c in word.translate(_LEET) if c.isalpha())


class Words(dict):
    """lower-case word -> row of ``rated``: (lexicon weight, 1 if only its plain form has one, 1 if second person); a bounded cache."""

    def __init__(self, lexicon: dict[str, float], bound: int = 200_000):
        self.lexicon, self.bound = lexicon, bound
        self.rows: dict[tuple[float, float, float], int] = {(0.0, 0.0, 0.0): 0}
        self.rated = np.zeros((1, 3))

    def __missing__(self, word: str) -> int:
        best = lambda w: max((self.lexicon.get(t, 0.0) for t in terms_of(w)), default=0.0) or _SEED_WEIGHT * (w in SEEDS)
        own, hidden = best(word), 0.0
        if not own and not word.isalpha() and (bare := plain(word)):
            own = best(bare)
            hidden = float(own > 0)
        if len(self) >= self.bound:
            self.clear()
        row = (own, hidden, float(word in _SECOND))
        if row not in self.rows:
            self.rows[row] = len(self.rows)
            self.rated = np.array(list(self.rows))
        self[word] = out = self.rows[row]
        return out


_CAPITALS, _BEYOND = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile("[\u00c0-\u00d6\u00d8-\u00de]")
_SHOUTED, _SIGNS, _STRETCHED = re.compile(r"\b[A-Z\u00c0-\u00d6\u00d8-\u00de]{3,}\b"), re.compile(r"[^\w\s]{2,}"), re.compile(r"([^\W\d_])\1\1")
_ODD = re.compile(r"(?<=[^\W\d_])[\d@$*!]+(?=[^\W\d_])")


def features(text: str, words: Words) -> list[float]:
    low = text.lower()
    found = _WORD.findall(low)
    n, chars = len(found), max(1, len(text))
    codes = np.fromiter(map(words.__getitem__, found), np.int64, n)
    rated = words.rated[codes]
    weight, hidden, second = rated[:, 0], rated[:, 1], rated[:, 2]
    hits, you = np.flatnonzero(weight > 0), np.flatnonzero(second > 0)
    near = 0
    gap = 1e4
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        left, right = you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)]
        gaps = np.minimum(np.abs(hits - left), np.abs(right - hits))
        near, gap = int((gaps <= _NEAR).sum()), float(gaps.min())
    per = max(1, n)
    data = text.encode()
    upper = len(data) - len(data.translate(None, _CAPITALS)) + (0 if len(data) == len(text) else len(_BEYOND.findall(text)))
    shouted = len(_SHOUTED.findall(text)) if upper >= 3 else 0
    odd = len(_ODD.findall(text))
    stretched = len(_STRETCHED.findall(low))
    top = [*np.sort(weight[hits])[::-1][:3].tolist(), 0.0, 0.0, 0.0]
    return [
        np.log1p(n), top[0], top[1], top[2], float(weight.sum()), float(weight.sum()) / per, float(len(hits)), len(hits) / per, float(hidden.sum()),
        near / per, min(gap, 1e4), len(you) / per, upper / chars, shouted / per, text.count("!") / chars, text.count("?") / chars,
        len(_SIGNS.findall(text)) / per, odd / per, stretched / per,
    ]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, ["fold", "term", "neg", "pos"])

    for batch in batches:
        for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            low = set(_WORD.findall((text.as_py() or "").lower()))
            counts[label].update({(fold, t) for w in low for t in terms_of(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
    yield out()


def lexica(train: DataFrame, folds: int = FOLDS, least: int = 3, odds: float = 1.5) -> list[dict[str, float]]:
    """Lexica of all folds but one each, and of all: terms -> smoothed log odds, those over ``odds`` with ``least`` toxic rows.

    Counts are summed in Spark; of the sampled rows' terms those that pass reach the driver.
    """
    sums = train.select("text", "label", "fold").mapInArrow(_counts, "fold int, term string, neg long, pos long").groupBy("fold", "term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    both = {(r["fold"], r["label"]): r["n"] for r in train.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    per = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(folds) for c in ("neg", "pos")]
    wide = sums.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), *per).where(F.col("pos") >= least)
    out = []
    all_neg, all_pos = (sum(n for (_, lab), n in both.items() if lab == v) for v in (0, 1))
    for f in [*range(folds), None]:
        pos, neg = (F.col(c) - F.col(f"{c}{f}") if f is not None else F.col(c) for c in ("pos", "neg"))
        n_pos, n_neg = all_pos - both.get((f, 1), 0), all_neg - both.get((f, 0), 0)
        weight = F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))
        out.append(wide.select(F.lit(len(out)).alias("which"), "term", weight.alias("w"), pos.alias("rows")).where((F.col("rows") >= least) & (F.col("w") >= odds)))
    frame = out[0]
    for o in out[1:]:
        frame = frame.unionByName(o)
    found: list[dict[str, float]] = [{} for _ in out]
    for r in frame.collect():  # words of the bounded sample
        found[r["which"]][r["term"]] = r["w"]
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, sample: int = SAMPLE, folds: int = FOLDS, scratch: Scratch | None = None):
    """(model, isotonic, lexicon) from the labelled rows that are not held out; without both classes a constant."""
    scratch = scratch or Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.max("label").alias("label"))
    rate = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("l_id"), F.lit(10**12)) < int(10**12 * rate))
    # The sample's bound is documented above, so its ids can be broadcast. Documents that repeat an id give one row.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("l_id", "label").agg(F.min("text").alias("text"))
    train = scratch.keep(met.select("text", "label", F.pmod(F.xxhash64("l_id", F.lit(1)), F.lit(folds)).cast("int").alias("fold")))
    classes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Constant(float(bool(classes.get(1)))), None, {}
    found = lexica(train, folds)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [Words(x, 100_000) for x in found]
        for batch in batches:
            fold = batch.column(2).to_pylist()
            x = [features(t.as_py() or "", caches[f]) for t, f in zip(batch.column(0), fold, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["label", "fold", "x"])

    rows = train.mapInArrow(extract, "label int, fold int, x array<double>").toArrow()
    y, fold = (rows.column(c).to_numpy().astype(np.int64) for c in (0, 1))
    x = rows.column(2).combine_chunks().values.to_numpy().reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, y, fold])  # rows come in no fixed order
    x, y, fold = x[order], y[order], fold[order]
    outside = np.zeros(len(y))
    for f in range(folds):
        rest = fold != f
        if (~rest).any():
            outside[~rest] = BoostedTrees().fit(x[rest], y[rest]).raw(x[~rest]) if 0 < y[rest].mean() < 1 else y[rest].mean()
    return BoostedTrees().fit(x, y), Isotonic().fit(outside, y.astype(float)), found[-1]


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """t_id, t_out, t_score, t_predicted, t_text and the other columns c0, c1, .. by their places, so that no names can clash."""
    model, calibrated, lexicon = fit(docs, labels, label, **options)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").alias("t_id"), held_out(F.col("doc_id")).alias("t_out"), F.col("text").alias("t_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            if calibrated is None:
                p = model.predict(np.zeros(len(batch)))
            else:
                x = np.array([features(t.as_py() or "", words) for t in batch.column("t_text")]).reshape(-1, N_FEATURES)
                p = calibrated.predict(model.raw(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "t_score", "t_predicted"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, t_score double, t_predicted int")


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; other columns are ignored.

    Null text counts as empty, and empty texts are scored like any others; null and repeated doc_ids are kept. A doc_id with several labels counts
    as toxic if one of them says so; of documents that repeat a doc_id the least text is learned from. Without labels of both kinds the score is 0, or 1 if all
    are 1. An empty table gives an empty result.
    """
    out = scored(docs.select("doc_id", "text"), labels, label, **options)
    return out.select(F.col("t_id").alias("doc_id"), F.col("t_out").alias("held_out"), F.col("t_score").alias("score"), F.col("t_predicted").alias("predicted"))


def non_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict to be toxic, with all their columns, whatever their names."""
    at = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c != "text")} | {"text": "t_text"}
    return scored(docs, labels, label, **options).where("t_predicted = 0").select(*[F.col(at[c]).alias(c) for c in docs.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
