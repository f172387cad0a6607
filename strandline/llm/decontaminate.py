"""Benchmark decontamination with suffix arrays over shards of the training texts.

Words are numbered by the benchmark's vocabulary (0: any other word, or an end), so a training suffix can match only as
far as its run of numbered words goes; suffixes whose run is shorter than the shortest window are left out of the array.
Several word numbers are packed into one 64-bit key, and a suffix is compared key by key. Each shard holds about
``SHARD`` words; every benchmark suffix is searched in it by bisection. The benchmark is broadcast only in slices of
``SLICE`` words at most; a larger one is handled slice by slice and merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch, ship
from . import words as w
from .lean import lean

WINDOW, SHARD, SLICE = 10, 1 << 18, 1 << 21
U = w.U


@dataclass
class Suffixes:
    """Suffixes of one number sequence, comparable key by key."""

    numbers: np.ndarray
    run: np.ndarray  # for each place, how many numbered words follow from there
    base: int
    per_key: int

    @classmethod
    def of(cls, numbers: np.ndarray, vocabulary: int) -> Suffixes:
        base = vocabulary + 1
        ends = np.append(np.flatnonzero(numbers == 0), len(numbers))
        run = np.repeat(ends, np.diff(ends, prepend=-1))[: len(numbers)].astype(np.int32) - np.arange(len(numbers), dtype=np.int32)
        return cls(numbers, run, base, max(1, int(63 / np.log2(max(base, 2)))))

    def key(self, at: np.ndarray, level: int, limit: np.ndarray | int | None = None) -> np.ndarray:
        """Key number ``level`` of the suffixes at ``at``, of which only ``limit`` words count."""
        run = self.run[at] if limit is None else np.minimum(self.run[at], limit)
        out = np.zeros(len(at), U)
        for j in range(level * self.per_key, (level + 1) * self.per_key):
            out *= U(self.base)
            ok = run > j
            out[ok] += self.numbers[at[ok] + j].astype(U)
        return out

    def array(self, at: np.ndarray, depth: int) -> np.ndarray:
        """``at`` in the order of the suffixes there, as far as ``depth`` words tell them apart."""
        order, rank = at, np.zeros(len(at), np.int64)
        for level in range(-(-depth // self.per_key)):
            k = self.key(order, level)
            if not k.any():
                break
            by = np.lexsort((k, rank))
            order, k, rank = order[by], k[by], rank[by]
            rank = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (k[1:] != k[:-1])]))[: len(at)]
            if len(rank) and rank[-1] == len(rank) - 1:
                break
        return order


def bisect(train: Suffixes, order: np.ndarray, test: Suffixes, at: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
    """For each test suffix, the first place in ``order`` whose first ``limit`` words are not below (right: are above) its own."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    levels = -(-int(limit.max(initial=0)) // test.per_key)
    mine = [test.key(at, k, limit) for k in range(levels)]
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        below, even = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k in range(levels):
            theirs = train.key(order[mid], k, limit[open_])
            own = mine[k][open_]
            below |= even & (theirs < own)
            even &= theirs == own
            if not even.any():
                break
        go = below | even if right else below
        lo[open_[go]] = mid[go] + 1
        hi[open_[~go]] = mid[~go]
    return lo


def common(train: Suffixes, a: np.ndarray, test: Suffixes, b: np.ndarray) -> np.ndarray:
    """Length in words of the longest common prefix of pairs of suffixes."""
    most, out, live = np.minimum(train.run[a], test.run[b]), np.zeros(len(a), np.int64), np.arange(len(a))
    k = 0
    while live.size:
        live = live[most[live] > k]
        live = live[train.numbers[a[live] + k] == test.numbers[b[live] + k]]
        out[live] += 1
        k += 1
    return out


@dataclass
class Benchmark:
    """What is broadcast of a slice of the benchmark."""

    vocabulary: np.ndarray  # sorted word hashes
    ids: list[str]
    numbers: np.ndarray
    item: np.ndarray  # for each place, the item; -1 at ends
    windows: np.ndarray  # place of one representative of each distinct window
    lengths: np.ndarray
    owners: np.ndarray  # items of each distinct window: owners[owned[i]:owned[i + 1]]
    owned: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: pa.Array, n: int) -> Benchmark:
        h, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for b in w.blocks(texts, w.ALNUM, True):
            h.append(b.hashes), counts.append(b.counts())
        h, counts = np.concatenate(h), np.concatenate(counts)
        vocabulary, number = np.unique(h, return_inverse=True)
        item = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) + item
        numbers, owner = np.zeros(len(h) + len(counts), np.int64), np.full(len(h) + len(counts), -1)
        numbers[place], owner[place] = number + 1, item
        suffixes = Suffixes.of(numbers, len(vocabulary))
        length = np.minimum(counts, n)[item]
        ok = np.flatnonzero((suffixes.run[place] >= length) & ((length == n) | (np.append(True, item[1:] != item[:-1])[: len(item)])))
        at, size = place[ok], length[ok]
        keys = [size] + [suffixes.key(at, k, size) for k in range(-(-n // suffixes.per_key))]
        by = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
        new = np.append(True, np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0))[: len(by)]
        group, first = np.cumsum(new) - 1, by[new]
        pairs = np.unique(np.stack([group, owner[at[by]]]), axis=1) if len(by) else np.zeros((2, 0), np.int64)
        return cls(vocabulary, ["" if i is None else str(i) for i in ids], numbers, owner, at[first], size[first], pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1)))

    def suffixes(self) -> Suffixes:
        return Suffixes.of(self.numbers, len(self.vocabulary))

    def number(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        k = np.searchsorted(self.vocabulary, h)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == h, k + 1, 0)


class Shard:
    """A suffix array over the words of some texts."""

    def __init__(self, bench: Benchmark, test: Suffixes, numbers: list[np.ndarray], counts: list[np.ndarray]):
        self.counts = np.concatenate(counts)
        self.bench, self.test = bench, test
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts + 1)
        full, inside = np.zeros(len(self.doc), np.int32), np.ones(len(self.doc), bool)
        inside[np.cumsum(self.counts + 1) - 1] = False
        full[inside] = np.concatenate(numbers)
        self.train = Suffixes.of(full, len(bench.vocabulary))
        least = int(bench.lengths.min(initial=1 << 30))
        self.order = self.train.array(np.flatnonzero(self.train.run >= least), int(self.test.run.max(initial=0)))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, place) of every occurrence here."""
        b = self.bench
        lo = bisect(self.train, self.order, self.test, b.windows, b.lengths, False)
        hi = bisect(self.train, self.order, self.test, b.windows, b.lengths, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return which, self.order[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]

    def judge(self) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """For each text: hit words, the items found, and a flag for each word place."""
        which, at = self.windows()
        edge = np.zeros(len(self.train.numbers) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.bench.lengths[which], -1)
        hit = np.cumsum(edge)[:-1] > 0
        n_hit = np.bincount(self.doc[hit], minlength=len(self.counts))
        pairs = np.unique(np.stack([self.doc[at], which]), axis=1)
        b, size = self.bench, np.diff(self.bench.owned)[pairs[1]]
        owner = b.owners[b.owned[pairs[1]].repeat(size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        found: list[set] = [set() for _ in self.counts]
        for d, i in zip(pairs[0].repeat(size).tolist(), owner.tolist(), strict=True):
            found[d].add(b.ids[i])
        return n_hit, [sorted(x) for x in found], hit

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every benchmark suffix: its place, the longest match here in words, and where that is."""
        at = np.flatnonzero(self.test.numbers)
        if not len(self.order) or not len(at):
            return at, np.zeros(len(at), np.int64), np.full(len(at), -1)
        k = bisect(self.train, self.order, self.test, at, self.test.run[at], False)
        best, where = np.full(len(at), -1), np.zeros(len(at), np.int64)
        for near in (np.maximum(k - 1, 0), np.minimum(k, len(self.order) - 1)):
            n = common(self.train, self.order[near], self.test, at)
            where, best = np.where(n > best, self.order[near], where), np.maximum(best, n)
        return at, best, where


def _shards(bench: Benchmark, batches):
    """(rows, Shard) of about SHARD words each; rows are (batch, first row, last row)."""
    numbers, counts, rows, size, test = [], [], [], 0, bench.suffixes()
    for batch in batches:
        for b in w.blocks(batch["text"], w.ALNUM, True):
            numbers.append(bench.number(b.hashes).astype(np.int32)), counts.append(b.counts()), rows.append(batch.slice(b.first, len(b)))
            size += len(b.hashes) + len(b)
            if size >= SHARD:
                yield rows, Shard(bench, test, numbers, counts)
                numbers, counts, rows, size = [], [], [], 0
    if rows:
        yield rows, Shard(bench, test, numbers, counts)


def _judged(shared):
    def run(batches):
        for rows, shard in _shards(shared.value, batches):
            n_hit, items, hit = shard.judge()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            spans: list[list[int]] = [[] for _ in shard.counts]
            first = np.cumsum(shard.counts + 1) - shard.counts - 1
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                d = shard.doc[a]
                spans[d] += [a - int(first[d]), b - int(first[d])]
            t = pa.Table.from_batches(rows)
            yield from pa.table([t["doc_id"].combine_chunks(), t["f"].combine_chunks(), pa.array(shard.counts), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "f", "n_words", "n_hit", "items", "spans"]).combine_chunks().to_batches()

    return run


_COLUMNS = "doc_id long, f long, n_words long, n_hit long, items array<string>, spans array<long>"


def slices(benchmark: DataFrame, n: int) -> tuple[int, Iterator[Benchmark]]:
    """How many slices the benchmark has, cut by a hash of the item into a bounded number of words, and the slices, one at
    a time."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = max(1, -(-size // (4 * SLICE)))
    rows = (bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i).toArrow() for i in range(k))
    return k, (Benchmark.build(x["item_id"].to_pylist(), x["text"], n) for x in rows)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """For every row of ``docs`` (doc_id, text; other columns are ignored): doc_id, f (hash of the text), n_words, n_hit,
    items (sorted strings) and spans (start, end, start, end, ... of hit words).

    Null or empty texts have no words; items without words are never found; an item of fewer than n words is one window.
    Items without item_id are found under the name ''. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("f"))
    count, benches = slices(benchmark, n)
    if count == 1:
        return docs.mapInArrow(lean(_judged(spark.sparkContext.broadcast(next(benches)))), _COLUMNS)
    scratch, whole = Scratch(spark), None
    for k, bench in enumerate(benches):  # one slice at a time; equal rows are one group with a count
        shared = spark.sparkContext.broadcast(bench)
        part = docs.mapInArrow(lean(_judged(shared)), _COLUMNS)
        part = part.groupBy("doc_id", "f").agg(F.first("n_words").alias("n_words"), F.first("items").alias("items"), F.first("spans").alias("spans"), F.count("*").alias("copies"))
        part = scratch.save(part, f"slice_{k}")
        shared.unpersist()
        whole = part if whole is None else whole.unionByName(part)
    joined = whole.groupBy("doc_id", "f").agg(F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("spans").alias("spans"))
    return joined.mapInArrow(_merged, _COLUMNS)


def _merged(batches):
    """One row for each copy, with the union of the spans that the slices of the benchmark found."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans: list[int] = []
            for a, b in sorted((x[k], x[k + 1]) for x in r["spans"] for k in range(0, len(x), 2)):
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                else:
                    spans += [a, b]
            rows += [{"doc_id": r["doc_id"], "f": r["f"], "n_words": r["n_words"], "n_hit": sum(spans[1::2]) - sum(spans[::2]), "items": sorted(r["items"]), "spans": spans}] * r["copies"]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("f", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))]))


def _clean(shared):
    def run(batches):
        for rows, shard in _shards(shared.value, batches):
            keep = pa.array(shard.judge()[0] == 0)
            yield from pa.Table.from_batches(rows).filter(keep).combine_chunks().to_batches()

    return run


def clean(docs: DataFrame, benchmark: DataFrame, columns: list[str], n: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (text among ``columns``) without any occurrence of a window, in one pass for each slice of the
    benchmark. Rows whose text is null, empty or without a window stay, repeated rows stay or go together; empty tables
    give no rows, or all."""
    spark, out = docs.sparkSession, docs.select(*columns)
    ship(spark)
    scratch = Scratch(spark)
    count, benches = slices(benchmark, n)
    for k, b in enumerate(benches, 1):
        shared = spark.sparkContext.broadcast(b)
        out = out.mapInArrow(lean(_clean(shared)), out.schema)
        if k < count:
            out = scratch.save(out, f"clean_{k}")
            shared.unpersist()
            scratch.drop(f"clean_{k - 1}")
    return out


def _longest(shared, column):
    def run(batches):
        bench = shared.value
        first = np.concatenate([[0], np.flatnonzero(bench.numbers == 0) + 1])
        best: dict[int, tuple[int, int | None, int]] = {}
        for rows, shard in _shards(bench, batches):
            at, n, where = shard.longest()
            ids = pa.Table.from_batches(rows)[column].to_pylist()
            start = np.cumsum(shard.counts + 1) - shard.counts - 1
            for i in np.flatnonzero(n > 0).tolist():
                d = int(shard.doc[where[i]])
                if n[i] > best.get(int(at[i]), (0,))[0]:
                    best[int(at[i])] = (int(n[i]), ids[d], int(where[i] - start[d]))
        if best:
            at = np.array(list(best))
            item = bench.item[at]
            yield pa.RecordBatch.from_arrays([pa.array([bench.ids[i] for i in item]), pa.array(at - first[item]), *(pa.array([v[k] for v in best.values()], pa.int64()) for k in range(3))], ["item_id", "item_word", "length", "doc_id", "doc_word"])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """For each suffix of each item with a match of at least a window: item_id, item_word (its start), and length, doc_id and
    doc_word of a longest verbatim match in ``docs``."""
    spark, out = docs.sparkSession, None
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for b in slices(benchmark, n)[1]:
        part = docs.mapInArrow(lean(_longest(spark.sparkContext.broadcast(b), "doc_id")), "item_id string, item_word long, length long, doc_id long, doc_word long")
        out = part if out is None else out.unionByName(part)
    top = F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct("length", -F.col("doc_id"), -F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(top.alias("m")).select("item_id", "item_word", "m.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
