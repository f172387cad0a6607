"""Token ids of whole texts, packed into rows of one length by best fit, longest first.

Texts are cut where white space follows something else: no token of the vocabulary's pattern spans such a place, so
the distinct pieces of many texts are encoded once each, joined into one call of the encoder. A text longer than a row
is split, losslessly. Pieces go, longest first, into the open row with the least room that still holds them; a segment
tree over room sizes finds it. Rows are packed within shards of about ``SHARD_TOKENS`` tokens, so that a task's memory
is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from . import words as w
from .lean import lean

TOKENIZER, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
# Fixed value: the pattern by which the public byte-level vocabulary cuts texts before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, SHARD_TOKENS, KNOWN = 2048, 2 << 20, 100_000
U = w.U
_cache: dict = {}


class Encoder:
    """Encodes the distinct pieces of texts, many in one call; remembers up to about KNOWN of them, in arrays sorted by hash."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(table.values(), default=0) + 1, np.int64)  # bytes of each id
        self.width[list(table.values())] = list(map(len, table))
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def texts(self, col) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column, in order."""
        raw, offs = w.column_bytes(col)
        i, n = 0, len(offs) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 20), "right")) - 1)
            yield from self._some(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j

    def _some(self, data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        starts = piece_starts(data, offs)
        ends = np.append(starts[1:], len(data))
        at = np.searchsorted(starts, offs)
        u, first, inv = np.unique(w.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN:
            self.forget()
        k = np.searchsorted(self.known, u)
        new = k == len(self.known)
        new[~new] = self.known[k[~new]] != u[~new]
        if new.any():
            last = np.zeros(len(starts) + 1, bool)
            last[at[1:] - 1] = True
            first = first[new]
            self._learn(u[new], data, starts[first], ends[first], last[first])
            k = np.searchsorted(self.known, u)
        begin, n = self.begin[k], self.size[k][inv]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(begin[inv] - total[:-1], n) + np.arange(total[-1])]
        for a, b in zip(total[at[:-1]], total[at[1:]], strict=True):
            yield out[a:b]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        """Adds distinct pieces, given by where they lie and whether a text ends there.

        Pieces with white space in front and none behind are joined and encoded in one call: no token spans their
        borders there either, so the bytes of the tokens tell which are whose. The others are encoded one by one.
        """
        joins = ~w.NOT_SPACE[data[starts]] & w.NOT_SPACE[data[ends - 1]] & ~(last & (data[ends - 1] >= 0x80))  # white space outside ASCII ends texts only
        order = np.argsort(~joins, kind="stable")
        hashes, starts, ends, m = hashes[order], starts[order], ends[order], int(joins.sum())
        upto = np.cumsum(ends[:m] - starts[:m])
        text = data[np.repeat(ends[:m] - upto, ends[:m] - starts[:m]) + np.arange(upto[-1] if m else 0)].tobytes()
        try:
            ids = np.array(self.encode(text.decode()), np.uint32)
        except UnicodeDecodeError:  # replaced bytes differ in number
            m, ids, upto = 0, np.zeros(0, np.uint32), upto[:0]
        size = np.diff(np.searchsorted(np.cumsum(self.width[ids]), upto, "right"), prepend=0)
        single = [self.encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(starts[m:].tolist(), ends[m:].tolist(), strict=True)]
        size = np.concatenate([size, np.fromiter(map(len, single), np.int64, len(single))])
        flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(single), np.uint32)])
        begin = len(self.flat) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.begin, self.size, self.flat = known[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order], flat


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of texts, and places where ASCII white space follows what is not white space."""
    space = ~w.NOT_SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    k = np.flatnonzero(cut)
    k = k[data[k - 1] >= 0x80]
    if len(k):  # white space outside ASCII
        a, b, c = data[k - 1], data[np.maximum(k - 2, 0)], data[np.maximum(k - 3, 0)]
        wide = (b == 0xC2) & ((a == 0xA0) | (a == 0x85))
        wide |= (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
        wide |= (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
        cut[k[wide]] = False
    first = offs[:-1]
    cut[first[np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


class Rooms:
    """Open rows by the room they have left: a segment tree tells the least room of at least some size."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        if not room:
            return
        self.rows[room].append(row)
        k = room + self.leaves
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its room) of the fullest row with room for ``need``."""
        k = need + self.leaves
        while not self.any[k]:
            while k & 1:  # a right child: nothing larger below this parent
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices of ``sizes`` (each 1 to length), by best fit, longest first."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            rows.append([i])
            rooms.put(length - sizes[i], len(rows) - 1)
        else:
            rows[found[0]].append(i)
            rooms.put(found[1] - sizes[i], found[0])
    return rows


def _packed(shared, length: int, end: int, kind):
    def shard(ids: list, tokens: list[np.ndarray]):
        pieces = [(k, a) for k, t in enumerate(tokens) for a in range(0, len(t), length)]
        sizes = [min(length, len(tokens[k]) - a) for k, a in pieces]
        name = hashlib.sha256(repr((ids, [len(t) for t in tokens])).encode() + b"".join(t[:64].tobytes() for t in tokens)).hexdigest()[:16]
        rows = {c: [] for c in ("shard", "row", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets", "ids")}
        for r, row in enumerate(best_fit(sizes, length)):
            at = np.concatenate([[0], np.cumsum([sizes[i] for i in row])])
            out = np.full(length, end, kind)
            for i, s in zip(row, at, strict=False):
                k, a = pieces[i]
                out[s : s + sizes[i]] = tokens[k][a : a + length]
            for c, v in zip(rows, (name, r, int(at[-1]), [ids[pieces[i][0]] for i in row], [pieces[i][1] for i in row], at.tolist(), at[:-1].tolist(), out.tobytes()), strict=True):
                rows[c].append(v)
            if len(rows["ids"]) == 256:
                yield _batch(rows)
                rows = {c: [] for c in rows}
        if rows["ids"]:
            yield _batch(rows)

    def run(batches):
        name = hashlib.sha256(shared.value).digest()
        if name not in _cache:  # one vocabulary at a time
            _cache.clear()
            _cache[name] = Encoder(shared.value)
        encoder = _cache[name]
        ids, tokens, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), encoder.texts(batch["text"]), strict=True):
                ids.append(i), tokens.append(np.append(t, np.uint32(end)))
                size += len(t) + 1
                if size >= SHARD_TOKENS:
                    yield from shard(ids, tokens)
                    ids, tokens, size = [], [], 0
        if ids:
            yield from shard(ids, tokens)
        encoder.forget()

    return lean(run)


_ROW = [("shard", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())]


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in _ROW], [c for c, _ in _ROW])


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Packed rows of the texts of ``docs`` (doc_id, text; other columns are ignored).

    Each text's ids are followed by ``end``. A row has ``length`` ids, little-endian of 2 bytes (4 if ``end`` or the vocabulary needs them),
    filled up with ``end``; n_tokens of them count. Segment k of a row is ids cu_seqlens[k] to cu_seqlens[k + 1], and is
    what starts at token doc_starts[k] of text doc_ids[k]; positions start anew at position_resets. Null and empty texts
    give one end token. Repeated rows are texts of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        table = f.read()
    kind = np.uint16 if max(end, *(int(line.split()[1]) for line in table.splitlines() if line)) < 1 << 16 else np.uint32
    ranks = spark.sparkContext.broadcast(table)
    schema = "shard string, row int, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(ranks, length, end, kind), schema)


def matrix(rows: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of some packed rows, as matrices."""
    ids = np.stack([np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * length else np.uint32) for r in rows])
    positions = np.tile(np.arange(length), (len(rows), 1))
    for r, p in zip(rows, positions, strict=True):
        cuts = [*r["cu_seqlens"], length]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p[a:b] = np.arange(b - a)
    return ids, positions


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, a table that any executor can read back row group by row group."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)
