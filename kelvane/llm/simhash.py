"""SimHash near-dedup by a binary trie self-join.

Fingerprints that differ in at most ``budget`` bits agree wholly on one of ``budget + 1`` blocks of bits. So the trie is
dealt out by block: tasks get the fingerprints that agree on a block, and in each such group the trie over the other
bits is joined with itself: pairs of nodes are walked down together, differing bits add up, and a pair is pruned when
they exceed the budget. A group of over ``limit`` fingerprints is dealt out again by blocks of its remaining bits, as
often as needed, so that no task has to hold a large group and no pair is lost.

Equal fingerprints are joined once. Documents get the component of their fingerprint at the end, in a join that AQE can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read
from kelvane.llm.graph import components, contract
from kelvane.llm.words import Rolling, WordHashes, mix64

SHINGLE_WORDS, BUDGET, LIMIT, SEED = 3, 2, 20_000, 42
FULL = (1 << 64) - 1
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined k-word shingles, repeats included, in pieces of at most 65536. Fewer words: of them all. No word: nothing."""
    words = text.lower().split()  # of bytes: A-Z only, and at the six white-space bytes only
    if not words:
        return
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, len(words) - k + 1, 65536):
        part = words[at : at + 65536 + k - 1]
        n = len(part) - k + 1
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[j : n + j] for j in range(k)), strict=True)), repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes (beginning at starts, none empty): the bits that are set in over half of them."""
    ends = np.append(starts[1:], len(hashes))
    sizes = ends - starts
    per = -(-sizes // 255)  # byte lanes hold sums of 255 rows
    first = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    begin = np.cumsum(per) - per
    out = np.zeros(len(starts), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, first)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        set_bits = 2 * counts > sizes[:, None]
        for byte in range(8):
            out |= set_bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints_of(texts: list[bytes | None], k: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    pieces: list[np.ndarray] = []
    whose: list[int] = []
    starts: list[int] = []
    size = 0

    def flush() -> None:
        if whose:
            out[whose] = majority(np.concatenate(pieces), np.array(starts))

    for i, text in enumerate(texts):
        began = size
        for piece in shingle_hashes(text or b"", k):
            pieces.append(piece)
            size += len(piece)
        if size > began:
            whose.append(i)
            starts.append(began)
        if size > 200_000:
            flush()
            pieces, whose, starts, size = [], [], [], 0
    flush()
    return out


def fingerprint(docs: DataFrame, k: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """(doc_id, fp): 64-bit SimHash as a signed long of each row; null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def split_mask(mask: int, parts: int, width: int = 64) -> list[int]:
    """The bits below width that the mask lacks, in so many runs of nearly equal length."""
    bits = [b for b in range(width) if not mask >> b & 1]
    at = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[at[i] : at[i + 1]]) for i in range(parts)]


def trie_pairs(keys: np.ndarray, bounds: np.ndarray, budget: int, width: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys (uint64, ascending within each group bounds[i]:bounds[i+1]) within the budget, in pieces.

    Walks the binary tries of all groups at once, level by level, on ranges of the sorted keys.
    """
    lo, hi = bounds[:-1], bounds[1:]
    keep = hi - lo > 1
    alo, ahi = lo[keep], hi[keep]
    blo, bhi = alo, ahi
    err = np.zeros(len(alo), np.int8)

    def compared(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (a1 - a0) * (b1 - b0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(b1 - b0, n)
        i, j = np.repeat(a0, n) + at // across, np.repeat(b0, n) + at % across
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        return i[near], j[near]

    for bit in range(width - 1, -1, -1):
        if not len(alo):
            return
        small = (ahi - alo) * (bhi - blo) <= 24
        if small.any():
            for part in np.array_split(np.flatnonzero(small), small.sum() // 100_000 + 1):
                yield compared(alo[part], ahi[part], blo[part], bhi[part])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        zeros = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit) & np.uint64(1)) == 0)])
        amid, bmid = alo + zeros[ahi] - zeros[alo], blo + zeros[bhi] - zeros[blo]
        other = alo != blo
        moved = [
            (alo, amid, blo, bmid, err, slice(None)), (amid, ahi, bmid, bhi, err, slice(None)),
            (alo, amid, bmid, bhi, err + 1, slice(None)), (amid, ahi, blo, bmid, err + 1, other),
        ]
        parts = []
        for a0, a1, b0, b1, e, which in moved:
            a0, a1, b0, b1, e = (x[which] for x in (a0, a1, b0, b1, e))
            go = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
            parts.append([x[go] for x in (a0, a1, b0, b1, e)])
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
    for a0, a1, b0, b1 in zip(alo, ahi, blo, bhi, strict=True):  # every bit is used up: ranges of equal keys
        step = max(1, 2_000_000 // int(b1 - b0))
        for at in range(a0, a1, step):
            yield compared(*(np.array([x]) for x in (at, min(a1, at + step), b0, b1)))


def spread(n: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """Links (i, those it reaches first) that connect all that pairs of 0 .. n - 1 connect; near(i, others) tells which of others are paired with i.

    Only what is not reached yet is compared, so that a dense group costs a few comparisons a member and never all pairs.
    """
    todo = np.arange(n)
    while len(todo):
        reached, todo = [int(todo[0])], todo[1:]
        while reached and len(todo):
            i = reached.pop()
            hit = near(i, todo)
            found, todo = todo[hit], todo[~hit]
            if len(found):
                yield i, found
                reached += found.tolist()


#: Groups of so many are looked at for density, by the pairs of so many members.
_DENSE, _PROBES, _PAIRS_EACH = 256, 32, 16


def _walker(budget: int, width: int, earlier: list[list[int]], payload: int, most: int | None):
    def dense(key: np.ndarray, words: tuple[np.ndarray, ...], node: np.ndarray) -> Iterator[tuple[int, int]]:
        def near(i: int, others: np.ndarray) -> np.ndarray:
            hit = np.bitwise_count((key[others] ^ key[i]).view(np.uint64)) <= budget
            if most is not None and hit.any():
                at = others[hit]
                hit[hit] = sum(np.bitwise_count((w[at] ^ w[i]).view(np.uint64)).astype(np.int64) for w in words) <= most
            return hit

        for i, found in spread(len(key), near):
            yield from zip(repeat(int(node[i])), node[found].tolist())

    def pairs(table: np.ndarray, branch: np.ndarray, value: np.ndarray, key: np.ndarray, node: np.ndarray, *words: np.ndarray) -> Iterator[tuple[int, int]]:
        new = np.flatnonzero((table[1:] != table[:-1]) | (branch[1:] != branch[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(key)]])
        # A group in which members have many partners is spread over; that gives the same components as all its pairs.
        crowds = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= _DENSE:
                probes = np.linspace(a, b - 1, _PROBES).astype(np.int64)
                if sum(int((np.bitwise_count((key[a:b] ^ key[p]).view(np.uint64)) <= budget).sum()) for p in probes) > _PROBES * _PAIRS_EACH:
                    crowds.append((a, b))
                    yield from dense(key[a:b], tuple(w[a:b] for w in words), node[a:b])
        if crowds:
            left = np.ones(len(key), bool)
            for a, b in crowds:
                left[a:b] = False
            table, branch, value, key, node, *words = (x[left] for x in (table, branch, value, key, node, *words))
            new = np.flatnonzero((table[1:] != table[:-1]) | (branch[1:] != branch[:-1]) | (value[1:] != value[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        for i, j in trie_pairs(key.view(np.uint64) ^ np.uint64(1 << 63), bounds, budget, width):
            diff = (key[i] ^ key[j]).view(np.uint64)
            once = np.ones(len(i), bool)
            for b in np.unique(branch[i]):  # a pair counts in the first of the blocks that it agrees on
                at = branch[i] == b
                for part in earlier[int(b)]:
                    once &= ~at | (diff & np.uint64(part) != 0)
            i, j = i[once], j[once]
            if most is not None:
                near = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in words) <= most
                i, j = i[near], j[near]
            yield from zip(node[i].tolist(), node[j].tolist(), strict=True)

    def all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        held = [np.zeros(0, np.int64)] * (5 + payload)
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) < 60_000:
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(last):  # the last group may go on in the next batch
                cut = last[-1] + 1
                yield from pairs(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from pairs(*held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in contract(all_pairs(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["src", "dst"])

    return run


def trie_links(rows: DataFrame, budget: int = BUDGET, limit: int = LIMIT, width: int = 64, most: int | None = None) -> DataFrame:
    """(src, dst): links with the components of all pairs of nodes whose keys in one table differ in at most ``budget`` bits.

    rows: a written table of ``t_table`` int, ``key`` long (its bits below width), ``node`` long and further longs. With ``most``, a pair
    also must not differ in more bits of the further columns. Pairs found in one task are contracted to stars at once.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [c for c in rows.columns if c not in ("t_table", "key", "node")]
    # Branches by number: the mask of agreed bits and the parts of which a pair must differ in each. Two branches may have the same mask.
    level: list[tuple[int, list[int]]] = [(0, [])]
    open_rows, out = rows.withColumn("branch", F.lit(0)), None
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        nexts = []
        for mask, before in level:
            parts = split_mask(mask, budget + 1, width)
            nexts += [(mask | part, [*before, *parts[:i]]) for i, part in enumerate(parts)]
        masks = F.array(*[F.lit(signed(m)) for m, _ in nexts])
        child = F.explode(F.array(*[F.col("branch") * (budget + 1) + i for i in range(budget + 1)]))
        keyed = open_rows.select("t_table", child.alias("branch"), "key", "node", *words).withColumn("value", F.col("key").bitwiseAND(F.element_at(masks, F.col("branch") + 1)))
        crowded = keyed.groupBy("t_table", "branch", "value").count().where(F.col("count") > limit).select("t_table", "branch", "value")
        # Below about this many open bits there is nothing left to deal out by.
        left = width - min(bin(m).count("1") for m, _ in nexts)
        more = left > 3 * (budget + 1) and not crowded.isEmpty()
        on = ["t_table", "branch", "value"]
        calm = keyed.join(crowded, on, "left_anti") if more else keyed
        found = calm.select(*on, "key", "node", *words).repartition(n, *on).sortWithinPartitions(*on, "key").mapInArrow(_walker(budget, width, [e for _, e in nexts], len(words), most), "src long, dst long")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        open_rows, level = keyed.join(crowded, on, "left_semi").select("t_table", "key", "node", *words, "branch"), nexts


def members(links: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes (node, least doc_id) -> (l_node, component_id, root): the smallest doc_id that links reach, and a node that stands for all."""
    roots = components(links, scratch)
    member = scratch.keep(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    low = member.join(nodes, "node").groupBy("root").agg(F.min("least").alias("low"))
    named = member.join(low, "root").select("node", "low", "root")
    return nodes.join(named, "node", "left").select(F.col("node").alias("l_node"), F.coalesce("low", "least").alias("component_id"), F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, *, k: int = SHINGLE_WORDS, budget: int = BUDGET, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest doc_id that links reach.

    Null and empty texts have the fingerprint zero and are linked like any others. Rows that repeat a doc_id are kept; null doc_ids
    count as larger than any other. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprint(docs, k, text))
    fps = scratch.keep(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    links = trie_links(fps.select(F.lit(0).alias("t_table"), F.col("node").alias("key"), "node"), budget, limit)
    label = scratch.keep(members(links, fps, scratch))  # written, so that AQE can split a frequent fingerprint
    return rows.join(label, F.col("fp") == F.col("l_node")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` but near copies: of each component the row of smallest doc_id stays, once.

    Rows without words are copies of each other. Null doc_ids count as largest; of rows that repeat a doc_id with different near texts
    the one of smallest hash stays. An empty table gives an empty result; all columns are carried through.
    """
    stays = near_copies(docs, text=text, **options).groupBy("root").agg(F.min(F.struct("d", "h")).alias("s")).select(F.col("s.d").alias("__d"), F.col("s.h").alias("__h"))
    keyed = docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__h", F.coalesce(F.xxhash64(text), F.lit(0)))
    return keyed.join(stays, ["__d", "__h"], "left_semi").dropDuplicates(["__d", "__h"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def shingle_sets(hashes: WordHashes, text: bytes | None, k: int) -> np.ndarray:
    """Ascending different hashes of the k-word shingles; of fewer words, of them all; without words none."""
    words = hashes((text or b"").lower().split())
    if not len(words):
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, len(words) - k + 1))
    return np.unique(Rolling(words).runs(at, at + min(k, len(words))))


def wide_fingerprints(docs: DataFrame, k: int, longs: int, similarity: float, text: str) -> DataFrame:
    """(d, h, node, size, w array<long>, prefix array<long>) of each row's set of k-word shingles.

    node is a hash of the whole set and size its number of shingles; w is its SimHash of 64 bits a long. prefix has the least
    size - ceil(similarity * size) + 2 shingles; two sets of that similarity share one of all but the last of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = mix64(np.arange(1, longs + 1, dtype=np.uint64))
        for batch in batches:
            out = np.zeros((len(batch), longs), np.uint64)
            node, size, prefix = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int32), []
            held: list[np.ndarray] = []
            whose: list[int] = []
            many = 0
            for row, t in enumerate(batch.column(2)):
                grams = shingle_sets(hashes, t.as_py(), k)
                n = size[row] = len(grams)
                node[row] = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)
                prefix.append(grams[: prefix_length(n, similarity) + 1 if n else 0].view(np.int64))
                if n:
                    held.append(grams)
                    whose.append(row)
                    many += n
                if held and (row == len(batch) - 1 or many > 60_000):
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in held[:-1]])]).astype(np.int64)
                    all_grams = np.concatenate(held)
                    for column, x in enumerate(salt):
                        out[whose, column] = majority(mix64(all_grams ^ x), starts)
                    held, whose, many = [], [], 0
            w = pa.FixedSizeListArray.from_arrays(pa.array(out.view(np.int64).ravel()), longs).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(size), w, pa.array(prefix, pa.list_(pa.int64()))], ["d", "h", "node", "size", "w", "prefix"])

    return docs.select("d", "h", F.col(text).cast("binary").alias("text")).mapInArrow(run, "d long, h long, node long, size int, w array<long>, prefix array<long>")


def least_common(size: int, similarity: float) -> int:
    """Shingles of a set of this size that a set of this Jaccard similarity has too, at least."""
    return math.ceil(similarity * size - 1e-9)


def prefix_length(size: int, similarity: float) -> int:
    return size - least_common(size, similarity) + 1


def most_bits(similarity: float, bits: int) -> int:
    """Bits that texts of this Jaccard similarity differ in on average, and five standard deviations more.

    The cosine of equally large sets is 2 J / (1 + J), and a bit differs with the angle's share of a half turn. Majorities of few shingles
    differ more often; at most a quarter more at similarity 0.8 (4 shingles against these and one more: 0.1875 instead of 0.1515).
    """
    p = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _groups(group: int):
    """Batches of rows sorted by the column of that number -> tables of one group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(group).to_numpy()
            if not len(own):
                continue
            at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if held and held[-1].column(group)[0].as_py() != own[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    return run


def prefix_keys(nodes: DataFrame, words: list, limit: int) -> DataFrame:
    """(p, node, words): the shingles of prefixes, of which two sets of that similarity share one.

    Where over ``limit`` sets share a shingle, it goes together with each larger one of a prefix one longer: two sets that share at least two
    shingles share two of those. Sets of one shingle have no partner but themselves.
    """
    own = F.slice("prefix", 1, F.size("prefix") - 1)
    each = nodes.where(F.size("prefix") > 1).select("node", "prefix", F.explode(own).alias("p"), *words)
    crowded = each.groupBy("p").count().where(F.col("count") > limit).select("p")
    names = [c for c in each.columns if c not in ("prefix", "p")]
    calm = each.join(crowded, "p", "left_anti").select("p", *names)
    if crowded.isEmpty():
        return each.select("p", *names)
    unsigned = F.struct(F.shiftrightunsigned("q", 1), F.col("q").bitwiseAND(F.lit(1)))
    twice = each.join(crowded, "p", "left_semi").select("p", *names, F.explode("prefix").alias("q")).where(unsigned > F.struct(F.shiftrightunsigned("p", 1), F.col("p").bitwiseAND(F.lit(1))))
    return calm.unionByName(twice.select(F.xxhash64("p", "q").alias("p"), *names))


def _shared_prefix(longs: int, most: int):
    """Rows (prefix, node, longs), sorted by prefix -> links that connect what pairs of a prefix within ``most`` bits connect."""

    def links(prefix: np.ndarray, node: np.ndarray, *words: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(prefix)]])
        shared = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[shared].tolist(), at[shared + 1].tolist(), strict=True):
            own = [w[a:b] for w in words]
            near = lambda i, others: sum(np.bitwise_count((w[others] ^ w[i]).view(np.uint64)).astype(np.int64) for w in own) <= most  # noqa: B023, E731
            for i, found in spread(b - a, near):
                yield from zip(repeat(int(node[a + i])), node[a + found].tolist())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        held = [np.zeros(0, np.int64)] * (2 + longs)
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(last):  # the last group may go on in the next batch
                yield from links(*(h[: last[-1] + 1] for h in held))
                held = [h[last[-1] + 1 :] for h in held]
        yield from links(*held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in contract(pairs(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["src", "dst"])

    return run


def similar(sets: list[np.ndarray], words: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Labels of the components of all pairs of ascending sets whose Jaccard similarity is at least that, among pairs within ``most`` bits.

    Pairs that are connected already need no comparison, so that a group of copies costs one comparison a row.
    """
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    for i in range(1, len(sets)):
        ratio = np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i]) - 1e-9
        bits = np.bitwise_count(words[:i] ^ words[i]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(ratio & (bits <= most))
        near = near[np.argsort(bits[near], kind="stable")]
        while len(near):
            near = near[label[near] != label[i]]
            some, near = near[:16], near[16:]
            if not len(some):
                break
            other = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
            common = np.add.reduceat(sets[i][at] == other, np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
            for j in some[common >= similarity * (size[some] + size[i] - common) - 1e-9].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
    return label


def _verified(k: int, similarity: float, most: int):
    """Rows (root, node, w, text), sorted by root -> (src, dst) stars of the nodes of a root that are alike by their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def with_sets() -> Iterator[pa.RecordBatch]:  # texts are let go as they are read
            for batch in batches:
                sets = pa.array([shingle_sets(hashes, t.as_py(), k).view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], ["root", "node", "w", "set"])

        for group in _groups(0)(with_sets()):
            node = group.column(1).to_numpy()
            words = np.array(group.column(2).combine_chunks().flatten()).reshape(len(node), -1).view(np.uint64)
            sets = [x.values.to_numpy().view(np.uint64) for x in group.column(3)]
            label = similar(sets, words, similarity, most)
            first: dict[int, int] = {}
            src, dst = [], []
            for x, y in zip(node.tolist(), label.tolist(), strict=True):
                if first.setdefault(y, x) != x:
                    src.append(x)
                    dst.append(first[y])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _alike(k: int, similarity: float):
    """Rows (node, text, leader, leader_text) -> (src, dst) of the nodes whose shingles are alike their leader's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, led = WordHashes(), {}
        for batch in batches:
            src, dst = [], []
            for node, text, leader, leader_text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if leader not in led:
                    if len(led) >= 8:
                        led.clear()
                    led[leader] = shingle_sets(hashes, leader_text.as_py(), k)
                own = shingle_sets(hashes, text.as_py(), k)
                common = len(np.intersect1d(own, led[leader], assume_unique=True))
                if node != leader and common >= similarity * (len(own) + len(led[leader]) - common) - 1e-9:
                    src.append(node)
                    dst.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


#: Shingles of the sets that one task verifies (8 bytes each), and the leaders of a larger component.
VERIFIED, LEADERS = 2_000_000, 3


def verified_links(wanted: DataFrame, texts: DataFrame, scratch: Scratch, k: int, similarity: float, most: int, least: int = VERIFIED) -> DataFrame:
    """(src, dst): links that connect all nodes of a root that pairs of a Jaccard similarity of at least ``similarity`` connect.

    wanted: a written table (root, node, size, w, d, h); texts: (d, h, text). Roots of up to ``least`` shingles are verified in one task each. In larger ones all nodes
    meet a few leaders first; those outside the largest cluster that this connects meet every node in a grid of tasks of about ``least`` shingles.
    """
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "src long, dst long"

    def with_text(rows: DataFrame, *columns: str) -> DataFrame:
        """One text for each (key, node): rows that repeat d and h have the same."""
        once = texts.dropDuplicates(["d", "h"]).select("d", "h", F.col("text").cast("binary").alias("text"))
        return rows.join(once, ["d", "h"]).select(*columns, "text")

    def verified(rows: DataFrame, key: str) -> DataFrame:
        return with_text(rows, key, "node", "w").repartition(n, key).sortWithinPartitions(key).mapInArrow(_verified(k, similarity, most), kinds)

    weight = scratch.keep(wanted.groupBy("root").agg(F.sum("size").alias("weight")).where(F.col("weight") > least))
    if weight.isEmpty():
        return verified(wanted, "root")
    out = verified(wanted.join(weight, "root", "left_anti"), "root")
    large = wanted.join(weight, "root")
    chosen = large.groupBy("root").agg(*[F.min_by(F.struct("node", "d", "h"), F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)])
    leaders = chosen.select("root", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("l")).select("root", "l.*")
    led = scratch.keep(with_text(leaders, "root", "node").withColumnsRenamed({"node": "leader", "text": "leader_text"}))
    near = scratch.keep(with_text(large, "root", "node").join(led, "root").select("node", "text", "leader", "leader_text").mapInArrow(_alike(k, similarity), kinds))
    out = out.unionByName(near)
    # What the leaders of a root connect falls into clusters. Pairs inside one are connected, and leaders have met every node already; any other pair may
    # still be alike, also of two nodes that met different leaders. So all but one cluster, the largest, go on.
    own = scratch.keep(large.join(components(near, scratch).withColumnRenamed("root", "star"), "node", "left").withColumn("star", F.coalesce("star", "node")))
    most_of = own.groupBy("root", "star").agg(F.sum("size").alias("of")).groupBy("root").agg(F.max_by("star", F.struct("of", "star")).alias("star"))
    rest = scratch.keep(own.join(most_of, ["root", "star"], "left_anti").drop("star").join(led.select(F.col("leader").alias("node")), "node", "left_anti"))
    if rest.isEmpty():
        return out
    parts = lambda c: F.greatest(F.lit(1), F.ceil(2 * F.col(c) / least)).cast("int")
    grid = scratch.keep(rest.groupBy("root").agg(F.sum("size").alias("rest")).join(weight, "root").select("root", parts("rest").alias("across"), parts("weight").alias("down")))
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["root", "node", "w", "d", "h"]
    rows = rest.join(grid, "root").select(*columns, at("across").alias("i"), every("down").alias("j")).unionByName(large.join(grid, "root").select(*columns, every("across").alias("i"), at("down").alias("j")))
    cells = rows.select(F.xxhash64("root", "i", "j").alias("cell"), "node", "w", "d", "h").dropDuplicates(["cell", "node"])
    return out.unionByName(verified(cells, "cell"))


def near_copies(docs: DataFrame, *, similarity: float = 0.8, k: int = 5, tables: int = 20, budget: int = 3, limit: int = LIMIT, text: str = "text", short: int = 100, carried: int = 3, verified: int = VERIFIED) -> DataFrame:
    """(d, h, component_d, root) per different row: the smallest d of the texts that links reach; root is equal within a component only.

    Texts are linked when the Jaccard similarity of their sets of k-word shingles is at least ``similarity``, verified on the sets. Candidates for it are:
    of texts of over ``short`` shingles, pairs of which one table's 32 bits differ in at most ``budget``, which 20 tables miss for one pair in 700 at similarity 0.8; for
    these, and of shorter ones, all pairs that share a shingle of their prefixes, which no similar pair lacks. Both must also be within ``most_bits``, five
    standard deviations, on ``carried`` longs of the fingerprint. d is doc_id, the largest long for null; h is a hash of the text.
    """
    scratch, longs = Scratch(docs.sparkSession), tables // 2
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.col(f"`{text}`")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.coalesce(F.xxhash64(own), F.lit(0)).alias("h"), own.alias("text"))
    wide = scratch.keep(wide_fingerprints(keyed, k, longs, similarity, "text"))
    rows = scratch.keep(wide.select("d", "h", "node"))
    nodes = scratch.keep(wide.groupBy("node").agg(F.min(F.struct("d", "h")).alias("first"), F.first("size").alias("size"), F.first("w").alias("w"), F.first("prefix").alias("prefix")))
    scratch.drop(wide)
    key = lambda t: F.shiftrightunsigned(F.element_at("w", t // 2 + 1), 32 * (t % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    some = [F.element_at("w", i + 1).alias(f"w{i}") for i in range(carried)]
    bits = most_bits(similarity, 64 * carried)
    each = nodes.where(F.col("size") > short).select(F.posexplode(F.array(*[key(t) for t in range(tables)])).alias("t_table", "key"), "node", *some)
    long_links = trie_links(each, budget, limit, 32, bits)
    short_links = prefix_keys(nodes, some, limit).repartition(n, "p").sortWithinPartitions("p").mapInArrow(_shared_prefix(carried, bits), "src long, dst long")
    roots = components(long_links.unionByName(short_links), scratch)
    candidates = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    wanted = scratch.keep(candidates.join(nodes.select("node", "size", "w", "first.d", "first.h"), "node"))
    links = verified_links(wanted, keyed, scratch, k, similarity, most_bits(similarity, 64 * longs), verified)
    label = scratch.keep(members(scratch.keep(links), nodes.select("node", F.col("first.d").alias("least")), scratch))
    return rows.join(label, F.col("node") == F.col("l_node")).select("d", "h", F.col("component_id").alias("component_d"), "root").distinct()


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
