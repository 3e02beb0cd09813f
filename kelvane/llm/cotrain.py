"""Quality by co-training: a text view and a metadata view teach each other, and their calibrated scores are combined.

The text view sees what a text consists of (shares of letters, capitals, signs and digits, word and line shapes, repetition); the metadata view sees
how good labelled rows of the same language and source are, how many there are, and the length field. Each view is a small boosted model. In every round both
views score all unlabelled rows in Spark; each labels those that it is sure of, the surest first, and the other view learns from them with its own labelled
rows. At the end each view is calibrated on labelled rows that its folds have not seen, and a logistic regression on both calibrated views scores all rows.

Bounds: at most ``sample`` labelled rows, chosen by a digest of doc_id and one for each doc_id, and ``teach`` pseudo-labelled rows of a class, view and round
reach the driver as dense features. Texts are read once: their features are written, and every pass goes over those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read
from kelvane.llm.models import BoostedTrees, Isotonic, Logistic, logit

SAMPLE, TEACH, ROUNDS, SURE, FOLDS = 20_000, 4_000, 3, 0.95, 3
N_TEXT, N_META = 22, 6

_SIGNS = re.compile(r"[^\w\s]")
_CAPITALS, _OTHERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(r"[^\x00-\x7f]")


def capitals(text: str) -> int:
    """Upper-case letters of the whole text."""
    data = text.encode()
    return len(data) - len(data.translate(None, _CAPITALS)) + (0 if len(data) == len(text) else sum(map(str.isupper, _OTHERS.findall(text))))


def text_features(text: str) -> list[float]:
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    distinct = len(set(words))
    signs = _SIGNS.findall(text)
    lengths = [len(w) for w in words]
    heads = len(set(lines))
    upper = sum(map(str.isupper, words))
    end = sum(w[-1] in ".!?" for w in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / k, float(np.std(lengths)) if words else 0.0, distinct / k,
        len(signs) / n, len(set(signs)) / max(1, len(signs)), upper / k, capitals(text) / n, sum(map(str.isdigit, words)) / k, len(re.findall(r"\d", text)) / n,
        text.count("|") / k, text.count("!") / k, len(re.findall(r"[^\w\s]{2,}", text)) / k, end / k, text.count(",") / k,
        len(lines) / k, heads / len(lines), float(max(map(len, lines))) / n, text.count("http") / k, text.count("\ufffd") / n, sum(not x[:1].isalpha() for x in words) / k,
    ]


class Rates:
    """Per value of a field: smoothed log odds of a good label and the logarithm of its labelled rows. Null is a value; unknown ones have the odds of all rows."""

    def __init__(self, values: list, y: np.ndarray, weight: float = 4.0):
        prior = (y.sum() + 1) / (len(y) + 2)
        sums: dict = {}
        for v, label in zip(values, y.tolist(), strict=True):
            own = sums.setdefault(v, [0, 0])
            own[label] += 1
        odds = lambda neg, pos: float(np.log((pos + weight * prior) / (neg + weight * (1 - prior))))
        self.known = {v: (odds(*n), float(np.log1p(sum(n)))) for v, n in sums.items()}
        self.unknown = (odds(0, 0), 0.0)

    def __call__(self, value) -> tuple[float, float]:
        return self.known.get(value, self.unknown)


def meta_features(lang: str | None, source: str | None, n_chars: int | None, langs: Rates, sources: Rates) -> list[float]:
    return [*langs(lang), *sources(source), float(np.log1p(max(0, n_chars or 0))), float(n_chars is None)]


def _text_view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = [text_features(x.as_py() or "") for x in batch.column("text")]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(t, pa.list_(pa.float64()))], [*rest, "t"])


def both_views(batch: pa.RecordBatch, langs: Rates, sources: Rates) -> tuple[np.ndarray, np.ndarray]:
    t = batch.column("t").flatten().to_numpy().reshape(-1, N_TEXT)
    m = [meta_features(a, b, c, langs, sources) for a, b, c in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")), strict=True)]
    return t, np.array(m).reshape(-1, N_META)


class View:
    """One classifier with its calibration from folds."""

    def fit(self, x: np.ndarray, y: np.ndarray, own: int, fold: np.ndarray, folds: int) -> View:
        """The first ``own`` rows are labelled; the others carry the other view's labels and are learned from in every fold."""
        self.model = BoostedTrees(trees=40).fit(x, y)
        outside = np.zeros(own)
        for f in range(folds):
            out = np.flatnonzero(fold == f)
            rest = np.concatenate([np.flatnonzero(fold != f), np.arange(own, len(y))])
            if len(out):
                outside[out] = BoostedTrees(trees=40).fit(x[rest], y[rest]).raw(x[out])
        self.outside = outside
        self.calibrated = Isotonic().fit(outside, y[:own].astype(float))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated.predict(self.model.raw(x))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, propose, rounds: int = ROUNDS, teach: int = TEACH, folds: int = FOLDS):
    """(text view, metadata view, combination, rows taught per round).

    propose(views, most, given) gives (view, label, key, text features, metadata features) of unlabelled rows that the view is sure of, the surest first.
    In a round a view teaches at most ``teach`` rows of a class, and no more than there are labelled ones, so that classes keep their shares.
    """
    own = len(y)
    given: list[dict] = [{}, {}]  # key -> (features, label) that each view was given
    taught = []
    most = [min(teach, int((y == label).sum())) for label in (0, 1)]
    for r in range(rounds + 1):
        views = []
        for x, extra in ((text, given[0]), (meta, given[1])):
            more = [extra[k] for k in sorted(extra)]
            views.append(View().fit(np.concatenate([x, *(f[None] for f, _ in more)]), np.concatenate([y, np.array([label for _, label in more], np.int64)]), own, fold, folds))
        if r == rounds:
            break
        new = [0, 0]
        counts = dict.fromkeys([(me, label) for me in (0, 1) for label in (0, 1)], 0)
        for me, label, key, t, m in propose(views, most, given):
            if key not in given[1 - me] and counts[me, label] < most[label]:
                given[1 - me][key] = (m if me == 0 else t, label)
                counts[me, label] += 1
                new[me] += 1
        taught.append(tuple(new))
        if not any(new):
            break
    both = np.column_stack([logit(v.calibrated.predict(v.outside)) for v in views])
    return views[0], views[1], Logistic().fit(both, y.astype(float)), taught


def proposals(free: DataFrame, langs: Rates, sources: Rates, scratch: Scratch, sure: float):
    """``propose`` of ``cotrain`` over all rows of a written table (row, tie, lang, source, n_chars, t)."""

    def propose(views, most, given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                t, m = both_views(batch, langs, sources)
                p = [views[0].predict(t), views[1].predict(m)]
                keep = pa.array((np.maximum(*p) >= sure) | (np.minimum(*p) <= 1 - sure))
                columns = [batch.column("row"), batch.column("tie"), batch.column("t"), pa.array(list(m), pa.list_(pa.float64())), *map(pa.array, p)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "tie", "t", "m", "p0", "p1"]).filter(keep)

        rows = scratch.keep(free.select("row", "tie", "lang", "source", "n_chars", "t").mapInArrow(run, "row long, tie long, t array<double>, m array<double>, p0 double, p1 double"))
        for me in (0, 1):
            p = F.col(f"p{me}")
            for label, certain, first in ((1, p >= sure, p.desc()), (0, p <= 1 - sure, p.asc())):
                if most[label]:
                    # What the other view was given before may stand first again.
                    best = rows.where(certain).orderBy(first, "tie", "row").limit(most[label] + len(given[1 - me])).select("row", "t", "m").toArrow()
                    for key, t, m in zip(*(best.column(c).to_pylist() for c in ("row", "t", "m")), strict=True):
                        yield me, label, key, np.array(t), np.array(m)
        scratch.drop(rows)

    return propose


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, teach: int = TEACH, rounds: int = ROUNDS, sure: float = SURE, held_out=None):
    """(written features of all rows, what ``score`` needs; None for that without labels of both kinds)."""
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("l_id").isNotNull())
    if held_out is not None:
        known = known.where(~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.min("label").alias("label"))
    chosen = known.where(F.pmod(F.xxhash64("l_id"), F.lit(10**12)) < int(1e12 * min(1.0, sample / max(1, known.count()))))
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    # The sample bounds the ids, so they can be broadcast.
    told = names.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "text", "lang", "source", "n_chars", "label", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", F.lit(2)).alias("tie"))
    table = scratch.keep(told.mapInArrow(_text_view, "doc_id long, lang string, source string, n_chars long, label int, row long, tie long, t array<double>"))
    one = table.where("label is not null").groupBy("doc_id").agg(F.min("row").alias("o_row"))
    data = table.join(one.select("o_row"), F.col("row") == F.col("o_row")).select("doc_id", "label", "lang", "source", "n_chars", "t", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")).toArrow()
    data = data.sort_by("doc_id")
    y, fold = (data.column(c).to_numpy().astype(np.int64) for c in ("label", "fold"))
    if len(np.unique(y)) < 2:
        return table, None
    lang, source, n_chars = (data.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    rates = lambda at: [Rates([v[i] for i in at.tolist()], y[at]) for v in (lang, source)]
    m = np.zeros((len(y), N_META))
    for f in range(FOLDS):  # a row's own label is not in its rates
        langs, sources = rates(np.flatnonzero(fold != f))
        for i in np.flatnonzero(fold == f).tolist():
            m[i] = meta_features(lang[i], source[i], n_chars[i], langs, sources)
    langs, sources = rates(np.arange(len(y)))
    t = data.column("t").combine_chunks().flatten().to_numpy().reshape(-1, N_TEXT)
    propose = proposals(table.where("label is null"), langs, sources, scratch, sure)
    return table, (*cotrain(t, m, y, fold, propose, rounds, teach), langs, sources)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for each row: calibrated probabilities of good quality.

    Null text counts as empty; null or unknown language, source and length have features of their own; null and repeated doc_ids are kept. A doc_id
    with several labels counts as good if all of them say so. Without labels of both kinds all scores are null and all rows are kept. An empty
    table gives an empty result; other columns are ignored.
    """
    table, fitted = fit(docs, labels, **options)
    if fitted is None:
        return table.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("keep"))
    text_view, meta_view, combine, _, langs, sources = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            t, m = both_views(batch, langs, sources)
            a, b = text_view.predict(t), meta_view.predict(m)
            p = combine.predict(np.column_stack([logit(a), logit(b)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(p), pa.array(p >= threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return table.select("doc_id", "lang", "source", "n_chars", "t").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
