"""Texts scored by a bigram model with deleted interpolation.

The probability of a word after a context is a mixture of three estimates: the bigram's and the unigram's relative
frequencies, and the unigram's with one added to every count, which gives unseen words their share. The mixture's
weights depend on how frequent the context is (buckets of powers of two) and are learnt by expectation-maximisation on
held-out counts: one fold of the training texts is left out of the relative frequencies for that, and is part of them
in the final model. A text ends with one end token, and the first word's context is the end token of the text before.

Counts stay distributed. Texts are dealt into slices; a slice asks for its distinct unigrams and bigrams, as sorted
blocks of hashes cut by hash range; each range merges the blocks of all slices, which gives the counts of the corpus, and
answers each block in its own order, with the counts alone: the slice finds its hashes again. So no slice sees, and no
driver or broadcast holds, more than what the slice asks. Weights are learnt on a histogram of the held-out tokens'
estimates, in bins of 10 ** (1 / ``GRID``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch, ship
from . import words as w
from .lean import lean_group

U = w.U
END = w.hash_of("\n")  # no word has white space
SLICE_BYTES, RANGE_BYTES = 8 << 20, 24 << 20
EVALUATE, TUNE = (7, 2), (7, 5)  # crc32(doc_id) modulo, remainder: never learnt from; for the weights
BUCKETS, STEPS, GRID = 24, 40, 24  # context buckets; steps of expectation-maximisation; bins per factor of 10
COMPONENTS = 3


def _pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit values: differences, byte by byte, compressed."""
    d = np.diff(x, prepend=x[:1] * 0)
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(x.T).view(U).ravel(), dtype=U)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts, as narrow as they fit; the first byte is the width."""
    width = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k)
    return bytes([width]) + zstandard.compress(x.astype(f"<u{width}").tobytes(), 1)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


@dataclass
class Tokens:
    """Tokens of some texts: each text's words and its end."""

    token: np.ndarray
    bigram: np.ndarray
    doc: np.ndarray


def _tokens(b: w.Words) -> Tokens:
    doc, n = b.doc(), len(b)
    token = np.full(len(b.hashes) + n, END, U)
    token[np.arange(len(b.hashes)) + doc] = b.hashes
    before = np.concatenate([[END], token[:-1]]).astype(U)
    return Tokens(token, w.mix(before * U(0x9E3779B97F4A7C15) + token), np.repeat(np.arange(n), b.counts() + 1))


def _count(values: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the sums of two weights of each."""
    x, y = np.concatenate(values or [np.zeros(0, U)]), np.concatenate(weights or [np.zeros((0, 2), np.int64)])
    by = np.argsort(x)
    x, y = x[by], y[by]
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.add.reduceat(y, new, axis=0) if len(new) else y


def _asked(ranges: int):
    """Of one slice: for each order and hash range, the distinct hashes with their counts in the two parts of training."""

    def run(key, table):
        found = {1: ([], []), 2: ([], [])}
        part = table["part"].to_numpy()
        for b in w.blocks(table["text"], w.NOT_SPACE, True):
            t = _tokens(b)
            p = part[b.first : b.first + len(b)][t.doc]
            weight = np.stack([p == 0, p == 1], axis=1).astype(np.int64)
            for order, x in ((1, t.token), (2, t.bigram)):
                x, y = _count([x], [weight])
                found[order][0].append(x), found[order][1].append(y)
        rows = {k: [] for k in ("slice", "order", "range", "hashes", "main", "tune")}
        for order, (x, y) in found.items():
            x, y = _count(x, y)
            cut = np.searchsorted((x >> U(32)).astype(np.int64) * ranges >> 32, np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                for c, v in zip(rows, (key[0].as_py(), order, int(k), _pack(x[s]), _pack_counts(y[s, 0]), _pack_counts(y[s, 1])), strict=True):
                    rows[c].append(v)
        return pa.table(rows, pa.schema([("slice", pa.int64()), ("order", pa.int32()), ("range", pa.int32()), ("hashes", pa.binary()), ("main", pa.binary()), ("tune", pa.binary())]))

    return run


def _answered(key, table):
    """Of one order and hash range: the corpus counts, for each block in its own order; and this range's totals."""
    blocks = [[f(x) for x in table[c].to_pylist()] for c, f in (("hashes", _unpack), ("main", _unpack_counts), ("tune", _unpack_counts))]
    x, y = _count(blocks[0], [np.stack([a, b], axis=1) for a, b in zip(blocks[1], blocks[2], strict=True)])
    known = (y.sum(axis=0)).tolist()
    distinct, distinct_main = int((y.sum(axis=1) > 0).sum()), int((y[:, 0] > 0).sum())
    n = len(table)
    at = [np.searchsorted(x, h) for h in blocks[0]]
    first = [k == 0 for k in range(n)]
    return pa.table(
        {
            "slice": table["slice"], "order": table["order"], "range": table["range"],
            "main": pa.array([_pack_counts(y[k, 0]) for k in at], pa.binary()), "tune": pa.array([_pack_counts(y[k, 1]) for k in at], pa.binary()),
            "n_main": pa.array([known[0] * f for f in first], pa.int64()), "n_tune": pa.array([known[1] * f for f in first], pa.int64()),
            "v": pa.array([distinct * f for f in first], pa.int64()), "v_main": pa.array([distinct_main * f for f in first], pa.int64()),
        }
    )


_ANSWER = "slice long, order int, range int, main binary, tune binary, n_main long, n_tune long, v long, v_main long"


@dataclass
class Model:
    n: int  # training tokens
    v: int  # distinct ones
    n_main: int
    v_main: int
    weights: np.ndarray  # (BUCKETS, COMPONENTS)


class Counts:
    """What a slice was told: ranges follow each other in the order of hashes, so their answers together fit its sorted hashes."""

    def __init__(self, texts, table: pa.Table):
        asked: dict[int, list] = {1: [], 2: []}
        for b in w.blocks(texts, w.NOT_SPACE, True):
            t = _tokens(b)
            asked[1].append(np.unique(t.token)), asked[2].append(np.unique(t.bigram))
        self.of = {}
        for order, x in asked.items():
            t = table.filter(pa.compute.equal(table["order"], order)).sort_by("range")
            main, tune = (np.concatenate([_unpack_counts(x) for x in t[c].to_pylist()] or [np.zeros(0, np.int64)]) for c in ("main", "tune"))
            self.of[order] = np.unique(np.concatenate(x or [np.zeros(0, U)])), main, tune

    def get(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, main, tune = self.of[order]
        at = np.searchsorted(x, hashes)
        return main[at], tune[at]


def _estimates(t: Tokens, c1: np.ndarray, c2: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the bucket of its context and its probability by each component."""
    context = np.concatenate([[0], c1[:-1]])
    first = np.concatenate([[True], t.doc[1:] != t.doc[:-1]])
    ends = c1[np.flatnonzero(t.token == END)[0]] if (t.token == END).any() else 0
    context[first] = ends
    p = np.empty((len(c1), COMPONENTS))
    p[:, 0] = c2 / np.maximum(context, 1)
    p[:, 1] = c1 / max(n, 1)
    p[:, 2] = (c1 + 1.0) / (n + v + 1.0)
    bucket = np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)
    return bucket, p


def _histogram(shared):
    """Of one slice, for the tokens of the tuning fold: how many fall in each cell of (bucket, estimates by bins)."""

    def run(key, docs, answers):
        n, v = shared.value
        counts, out = Counts(docs["text"], answers), {}
        for b in w.blocks(docs["text"], w.NOT_SPACE, True):
            t = _tokens(b)
            bucket, p = _estimates(t, counts.get(1, t.token)[0], counts.get(2, t.bigram)[0], n, v)
            bins = np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int64)
            cells, k = np.unique(np.column_stack([bucket, bins]), axis=0, return_counts=True)
            for cell, m in zip(map(tuple, cells.tolist()), k.tolist(), strict=True):
                out[cell] = out.get(cell, 0) + m
        rows = [(*cell, m) for cell, m in out.items()]
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("bucket", "p0", "p1", "p2", "n"))})

    return run


def learn(cells: np.ndarray) -> np.ndarray:
    """Weights for each bucket from rows (bucket, bins, count). Buckets without held-out tokens take the overall weights."""
    p = np.where(cells[:, 1:4] == 1, 0, 10.0 ** (cells[:, 1:4] / GRID))
    n, bucket = cells[:, 4].astype(float), cells[:, 0]

    def fit(rows):
        x = np.full(COMPONENTS, 1 / COMPONENTS)
        for _ in range(STEPS):
            share = p[rows] * x
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            total = (share * n[rows, None]).sum(axis=0) + 0.1  # no component ever gets nothing
            x = total / total.sum()
        return x

    rest = fit(np.arange(len(n))) if len(n) else np.array([0.2, 0.3, 0.5])
    out = np.tile(rest, (BUCKETS, 1))
    for k in np.unique(bucket):
        out[k] = fit(np.flatnonzero(bucket == k))
    return out


def _scores(shared):
    def run(key, docs, answers):
        m, counts = shared.value, Counts(docs["text"], answers)
        out = [[], [], [], []]
        for b in w.blocks(docs["text"], w.NOT_SPACE, True):
            t = _tokens(b)
            (a1, h1), (a2, h2) = counts.get(1, t.token), counts.get(2, t.bigram)
            c1 = a1 + h1
            bucket, p = _estimates(t, c1, a2 + h2, m.n, m.v)
            for o, x in zip(out, (np.ones(len(c1)), c1 > 0, np.log10(p[:, 2]), np.log10((p * m.weights[bucket]).sum(axis=1))), strict=True):
                o.append(np.bincount(t.doc, x, len(b)))
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"doc_id": docs["doc_id"], "held_out": pa.compute.equal(docs["part"], 2), "n_tokens": pa.array(cols[0].astype(np.int64)), "n_known": pa.array(cols[1].astype(np.int64)), "train_tokens": pa.array(np.full(len(docs), m.n, np.int64)), "base_score": pa.array(cols[2]), "score": pa.array(cols[3])})

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Null and empty texts have the end token alone. Rows without doc_id are trained on. Repeated rows count each time and
    have equal scores. An empty table gives no rows. base_score is the sum of
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the text, its end included.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    part = F.when(crc % EVALUATE[0] == EVALUATE[1], 2).when(crc % TUNE[0] == TUNE[1], 1).otherwise(0).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, ranges = max(1, -(-size // SLICE_BYTES)), max(1, -(-size // RANGE_BYTES))
    # texts of the tuning fold have slices of their own
    tuned = max(1, slices // TUNE[0])
    dealt = docs.withColumn("slice", F.when(F.col("part") == 1, -1 - F.pmod(F.xxhash64("doc_id", "text"), F.lit(tuned))).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))).cast("long"))
    ask = dealt.groupBy("slice").applyInArrow(lean_group(_asked(ranges)), "slice long, order int, range int, hashes binary, main binary, tune binary")
    answers = scratch.save(ask.groupBy("order", "range").applyInArrow(lean_group(_answered), _ANSWER), "answers")
    del ask
    scratch.release()
    n_main, n_tune, v, v_main = answers.where("order = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_main", "n_tune", "v", "v_main"))).first()
    told = answers.select("slice", "order", "range", "main", "tune")
    held = dealt.where("slice < 0").groupBy("slice").cogroup(told.where("slice < 0").groupBy("slice"))
    cells = held.applyInArrow(lean_group(_histogram(spark.sparkContext.broadcast((n_main, v_main)))), "bucket long, p0 long, p1 long, p2 long, n long")
    cells = cells.groupBy("bucket", "p0", "p1", "p2").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "p0", "p1", "p2"]).to_numpy(np.int64)
    scratch.release()
    model = Model(n_main + n_tune, v, n_main, v_main, learn(cells))
    whole = dealt.groupBy("slice").cogroup(told.groupBy("slice"))
    return whole.applyInArrow(lean_group(_scores(spark.sparkContext.broadcast(model))), _SCORED)
