"""Packing documents into sequences by non-negative least squares over a histogram of lengths.

Documents are tokenised once, by white-space separated words with a bounded cache. A document is cut into whole windows, which need no
packing, and one remainder below the window. The remainders' histogram, at most ``window`` numbers however large
the corpus, is what the driver solves: columns are shallow combinations of 2 to 4 occupied lengths that fill a
window, their repeat counts come from non-negative least squares, are rounded down, and what is left over is packed greedily,
best fit first, with counts instead of single pieces. The plan says which ranks of each length go where; ranks are dealt out in
parallel: counts per length and digest bucket, prefix sums over the buckets, and a window inside each bucket.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read

WINDOW, END_ID, VOCABULARY = 4096, 2, "word_bpe_49k.json"
BUCKETS = 512


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts as the tokenizer gives them, joined from those of their words.

    Right for tokenizers that drop white space and never join across it. Only space and line feed part words here; any
    other white space stays inside one for the tokenizer to handle. Texts are parted and their words dictionary-encoded in Arrow, so
    that Python sees each different word of a slice once; ``bound`` words are kept between slices at most.
    """

    def __init__(self, path: str, bound: int = 300_000):
        self.tokenizer, self.bound, self.known = _tokenizer(path), bound, {"": b""}
        self.model = self.tokenizer.model
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether this file lower-cases, keeps a run of letters as one word and parts it from signs; else every word goes to the tokenizer itself."""
        probe = ["a", "Zq", "HELLO", "internationalisation", "\u00c9\u00e0\u00fc", "stra\u00dfe", "\u00d1AND\u00da", "\u0153uvre", "\u0126\u0138\u0142\u014b", "$$$", "...", "!?", "<|"]
        probe += [h + w + t for w in ("word", "\u00dcber", "x") for h, t in (("", "."), ("", ",!!"), ("(", ")"), ('"', "$$$"), ("#", "..."), ("", "%%%"), ("<|", "|>"), ("", "-"), ("``", "~^"))]
        parts = pc.extract_regex(pa.array(probe), _FORM)
        try:
            own = [[i for x in (f["h"], f["c"].lower(), f["t"]) if x for i in self._part(x)] for f in parts.to_pylist()]
        except Exception:  # the model has no symbols for these bytes
            return False
        return own == [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]

    def _part(self, part: str) -> list[int]:
        symbols = part if part.isascii() else part.encode().decode("latin-1").translate(_SYMBOLS)
        return [x.id for x in self.model.tokenize(symbols)]

    def _learn(self, parts: list[str], plain: list[bool]) -> None:
        new = [(p, known) for p, known in zip(parts, plain, strict=True) if p not in self.known]
        if len(self.known) + len(new) > self.bound:
            self.known = {p: self.known[p] for p in ["", *parts] if p in self.known}
        odd = [p for p, known in new if not known]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for p, e in zip(odd, encode(odd, add_special_tokens=False), strict=True):
            self.known[p] = array("I", e.ids).tobytes()
        for p, known in new:
            if known:
                self.known[p] = array("I", self._part(p)).tobytes()

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these different words one after the other, how many each has)."""
        form = pc.extract_regex(words, _FORM)  # null for words of another form
        fits = pc.and_(pc.is_valid(form), pa.scalar(self.plain))
        empty = pa.scalar("")
        columns = [pc.if_else(fits, form.field("h"), empty), pc.if_else(fits, pc.utf8_lower(form.field("c")), words), pc.if_else(fits, form.field("t"), empty)]
        coded = pa.concat_arrays(columns).dictionary_encode()
        parts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        odd = np.zeros(len(parts), bool)
        odd[index[len(words) : 2 * len(words)][~fits.to_numpy(zero_copy_only=False)]] = True
        self._learn(parts, (~odd).tolist())
        ids, n = gathered([self.known[p] for p in parts], index.reshape(3, -1).T.ravel())
        return ids, n.reshape(-1, 3).sum(axis=1)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the last ends)."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids, sizes = self._words(coded.dictionary)
        index = coded.indices.to_numpy()
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        per = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        return ids[runs(starts[index], n)], ends[per]


def runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + n[0] - 1, starts[1] .. and so on; 32 bits, since a slice has fewer ids than that."""
    before = np.cumsum(n) - n
    return np.arange(n.sum(), dtype=np.int32) + np.repeat((starts - before).astype(np.int32), n)


def gathered(parts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts[i] for the i of index, one after the other, and how many each has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[index]
    return np.frombuffer(b"".join(parts), "<u4")[runs(starts[index], n)], n


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _byte_symbols()
#: Signs, letters, signs: ASCII signs but the apostrophe, which tokenizers treat in ways of their own, and Latin letters that are one letter in either case.
_FORM = r"^(?P<h>[!-&(-/:-@\[-`{-~]*)(?P<c>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]*)(?P<t>[!-&(-/:-@\[-`{-~]*)$"


#: Bytes of text that are tokenised at a time; a longer text makes a slice of its own. What a worker holds while it joins ids grows with this.
SLICE = 2_000_000


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes in a column, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, *, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): each row's ids and the end id, cut at multiples of the window.

    ``salt`` numbers the rows of a task, which tells equal rows apart once they are written.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(path)
        end, row = np.array([end_id], "<u4").tobytes(), 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
        for batch in batches:
            for part in slices(batch, 1):
                cols: list[list] = [[] for _ in names]
                ids, at = coder.encode(pc.fill_null(part.column(1), ""))
                for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own, n = ids[a:b].tobytes() + end, b - a + 1
                    for first in range(0, n, window):
                        piece = own[4 * first : 4 * (first + window)]
                        for col, v in zip(cols, (doc_id, first, len(piece) // 4, zlib.crc32(piece), n, row), strict=True):
                            col.append(v)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def combinations(hist: np.ndarray, window: int, slack: int = 0, most: int = 6000, seed: int = 7) -> np.ndarray:
    """Shallow combinations (rows of 4 lengths, 0 for none) of occupied lengths that sum to window - slack .. window.

    ``most`` bounds the columns of the least-squares problem, not what is packed; with fewer pieces there are fewer
    columns still, so that repeat counts don't all round to nothing.

    All pairs, and triples and quadruples of seeded choice, long lengths first; each is filled by the longest occupied length that fits.
    """
    have = np.flatnonzero(hist)
    have = have[(have > 0) & (have < window)]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    fit = np.zeros(window + 1, np.int64)  # largest occupied length up to an index
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    most = min(most, max(64, int(hist[have].sum()) // 8))
    rng = np.random.default_rng(seed)
    p = hist[have] / hist[have].sum()
    n = 2 * most
    draw = lambda: rng.choice(have, n, p=p)
    a, b, c = draw(), draw(), draw()
    zero = np.zeros(n, np.int64)
    rows = [np.stack([have, fit[window - have], np.zeros_like(have), np.zeros_like(have)], 1), *(np.stack(x, 1) for x in ((a, b, fit[np.maximum(window - a - b, 0)], zero), (a, b, c, fit[np.maximum(window - a - b - c, 0)])))]
    out = np.sort(np.concatenate(rows), axis=1)[:, ::-1]
    total = out.sum(1)
    out = np.unique(out[(total <= window) & (total >= window - slack)], axis=0)
    if len(out) > most:
        out = out[np.sort(rng.choice(len(out), most, replace=False))]
    return out


def solve_counts(combos: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths to the histogram in the least-squares sense.

    Multiplicative updates (Lee & Seung): x * (A'h) / (A'Ax) keeps x non-negative and never raises the error.
    """
    if not len(combos):
        return np.zeros(0)
    h = hist.astype(float)
    h[0] = 0
    used = combos > 0
    gather = lambda v: (v[combos] * used).sum(1)
    x = np.full(len(combos), h.sum() / max(1, used.sum()))
    target = gather(h)
    for _ in range(rounds):
        now = np.bincount(combos.ravel(), (x[:, None] * used).ravel(), len(h))
        x *= target / np.maximum(gather(now), 1e-12)
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] that use up the histogram exactly."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    for i in np.argsort(-(x := np.floor(solve_counts(combos, left) + 1e-9)), kind="stable"):
        need = [int(v) for v in combos[i] if v]
        times = int(x[i])
        for v in set(need):
            times = min(times, int(left[v]) // need.count(v))
        if times > 0:
            out.append((tuple(need), times))
            for v in need:
                left[v] -= times
    # Greedy on counts: the longest length takes, again and again, the longest that still fits; the same pattern
    # is repeated as often as the counts allow.
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        need, room, held = [], window, left.copy()
        while room > 0:
            fits = np.flatnonzero(held[: room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            need.append(v)
            held[v] -= 1
            room -= v
        times = min(int(left[v]) // need.count(v) for v in set(need))
        out.append((tuple(need), times))
        for v in need:
            left[v] -= times


def ranked(rows: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank``, from 0 within each key, with no group of a key's rows in one task: only 1/buckets of them are."""
    dealt = rows.withColumn("r_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy(key, "r_bucket").agg(F.count("*").alias("n"))
    prior = sums.select(F.col(key).alias("k_key"), F.col("r_bucket").alias("k_bucket"), F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("r_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("prior"))
    inside = F.row_number().over(W.partitionBy(key, "r_bucket").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(prior, (F.col(key) == F.col("k_key")) & (F.col("r_bucket") == F.col("k_bucket"))).withColumn("rank", F.col("prior") + F.col("inside")).drop("r_bucket", "k_key", "k_bucket", "prior", "inside")


def placed(rows: DataFrame, patterns: list[tuple[tuple[int, ...], int]], length: str = "length") -> DataFrame:
    """Adds sequence_id and offset. The plan is an array of runs per length: at most four slots per combination and one per greedy pick."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for need, times in patterns:
        offset = 0
        for v in need:
            first = taken.get(v, 0)
            runs.setdefault(v, []).append((first, base, offset))
            taken[v] = first + times
            offset += v
        base += times
    table = {v: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for v, r in runs.items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c not in ("rank",)]
    at = rows.columns.index(length), rows.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for v in np.unique(size):
                mine = size == v
                first, start, offset = shared.value[int(v)]
                i = np.searchsorted(first, rank[mine], "right") - 1
                seq[mine], off[mine] = start[i] + rank[mine] - first[i], offset[i]
            cols = [batch.column(n) for n in names] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in names)
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, *, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and gives the end id alone. Rows that repeat a doc_id are packed as documents of their own,
    null doc_ids as well. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, path=path, window=window, end_id=end_id, text=text))
    hist = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``window`` rows
        hist[length] = n
    rows = ranked(cut, "length", ["doc_id", "start", "ids_crc32", "salt"])
    return placed(rows, plan(hist, window)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
