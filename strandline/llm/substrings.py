"""Removes passages that repeat anywhere in a corpus, with suffix automata over shards of it.

Every window of ``window`` words has an anchor: the smallest hash among its 8-word grams, leftmost on ties. Consecutive
windows with the same anchor place are one segment. Equal windows have equal anchors at the same offset, so only
segments of one anchor can share a window: these are a shard. Segments that occur again and again are kept once, with
their number. A shard with one distinct segment needs no search. For others, a suffix automaton of the shard's distinct
segments, with weighted occurrence counts on its states, is what its segments are streamed through; the matching
statistics give the places where the longest suffix that occurs twice has at least ``window`` words. An automaton takes
some hundred bytes a word, so a shard of more than ``AUTOMATON`` distinct segments counts its windows by 128-bit hashes
instead: within its task up to ``LARGE`` segments (tens of MB), beyond that spread over all tasks.

Shards reach their documents by key, not by broadcast: sending all shards to all documents would take work that grows
with the square of the corpus. A key that holds many rows of a join is dealt over as many parts as it has
``PARTS``-ths of all rows, so that no task gets much more than one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch, ship
from . import words as w
from .bitmap import bitmap, passes, place
from .lean import lean

WINDOW, GRAM, AUTOMATON, LARGE, PARTS = 35, 8, 500, 100_000, 4096
U = w.U
NO_ID = -(1 << 63)


class SuffixAutomaton:
    """Of several sequences; ``count`` is how often, by weight, the strings of a state occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link), self.length.append(length), self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the strings of q that p reaches by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, weight: int) -> None:
        at = 0
        for c in sequence:
            if c in self.next[at]:
                at = self._split(at, c, self.next[at][c])
            else:
                new, p = self._state(self.length[at] + 1, 0, {}), at
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                at = new
            self.count[at] += weight

    def close(self) -> None:
        """Passes counts on to suffixes; call once, after the last ``add``."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def statistics(self, sequence, least: int = 2) -> list[int]:
        """For each place, the length of the longest string ending there that occurs ``least`` times or more."""
        out, at, size = [], 0, 0
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if c in self.next[at]:
                at, size = self.next[at][c], size + 1
            s, n = at, size
            while s and self.count[s] < least:
                s = self.link[s]
                n = self.length[s]
            out.append(n if s else 0)
        return out


def _lowest(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of the smallest, leftmost on ties."""
    n = len(g) - width + 1
    value, at, size = g.copy(), np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] < value[: len(value) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        size += step
    return at[:n]


def _segments(b: w.Words, window: int):
    """Segments of all texts: (anchor hash, anchor place, first window, last window, text), places over all words."""
    gram = min(GRAM, window)
    g, full = w.grams(b.hashes, gram), w.whole(b.counts(), window)
    if not len(full):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z, z
    at = _lowest(g, window - gram + 1)[full]
    doc = b.doc()[full]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(full)) - 1
    return g[at[new]], at[new], full[new], full[last], doc[new]


def _prints(h: np.ndarray, anchor_at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo to hi - 1, and of the anchor's offset."""
    up, down = w._pow(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(w.mix(h ^ U(0x2545F4914F6CDD1D)) * up[: len(h)], out=total[1:])
    return w.mix((total[hi] - total[lo]) * down[lo] + w.mix((hi - lo).astype(U) << U(32) | (anchor_at - lo).astype(U)))


def _found(window):
    def run(batches):
        for batch in batches:
            for b in w.blocks(batch["text"], w.NOT_SPACE, False):
                anchor, at, first, last, doc = _segments(b, window)
                fp = _prints(b.hashes, at, first, last + window)
                rows = batch.slice(b.first, len(b)).select(["d", "f"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64)), pa.array((first - b.at[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["d", "f", "anchor", "fp", "first", "windows"])

    return run


_FOUND = "d long, f long, anchor long, fp long, first int, windows int"


def _texts(bits, columns):
    """Rows whose key may be wanted."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch["h"].to_numpy()))).select(columns)

    return run


class _Hot:
    """Keys with two ``PARTS``-ths or more of all rows; there are at most half of ``PARTS``, so they are broadcast."""

    def __init__(self, counts: DataFrame, on: list[str], n: str):
        self.on, total = on, counts.agg(F.sum(n)).first()[0] or 1
        parts = counts.select(*on, F.expr(f"{n} * {PARTS} div {total}").alias("parts")).where("parts > 1")
        self.parts = counts.sparkSession.createDataFrame(parts.collect(), parts.schema)

    def join(self, rows: DataFrame, one: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``one``, which has each key once. Rows of a hot key are dealt over its parts, equal
        ones by their partition; ``one`` is copied to each part, at most 1.5 times ``PARTS`` copies in all."""
        zero, parts = F.lit(0).cast("long"), F.broadcast(self.parts)
        part = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), "parts")
        dealt = rows.join(parts, self.on, "left").withColumn("part", F.coalesce(part, zero)).drop("parts")
        last = F.coalesce(F.col("parts") - 1, zero)
        copied = one.join(parts, self.on, "left").withColumn("part", F.explode(F.sequence(zero, last))).drop("parts")
        return dealt.join(copied, [*self.on, "part"]).drop("part")


def _contents(window):
    """The words of wanted segments, 6 bytes of hash each."""

    def run(batches):
        for batch in batches:
            wanted = batch["wanted"]
            for b in w.blocks(batch["text"], w.NOT_SPACE, False):
                short = np.ascontiguousarray(b.hashes[:, None].view(np.uint8).reshape(-1, 8)[:, :6])
                rows = []
                for i in range(len(b)):
                    for x in wanted[b.first + i].as_py():
                        lo = b.at[i] + x["first"]
                        rows.append({"anchor": x["anchor"], "fp": x["fp"], "copies": x["copies"], "size": x["size"], "words": short[lo : lo + x["windows"] + window - 1].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("copies", pa.int64()), ("size", pa.int64()), ("words", pa.binary())]))

    return run


def _hashes(words: bytes) -> np.ndarray:
    x = np.zeros((len(words) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(words, np.uint8).reshape(-1, 6)
    return x.view(U).ravel()


def _counted(segments: list[bytes], copies: list[int], window: int) -> list[bytes]:
    """For each window of each segment, whether it occurs twice or more among all, by hashes of windows."""
    pairs = [(w.grams(h, window), w.grams(w.mix(h), window)) for h in map(_hashes, segments)]
    size = np.array([len(x) for x, _ in pairs])
    a, b = (np.concatenate([p[k] for p in pairs]) for k in range(2))
    by = np.lexsort((b, a))
    new = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
    group = np.cumsum(new) - 1
    flags = np.empty(len(by), np.uint8)
    flags[by] = (np.bincount(group, np.repeat(copies, size)[by]) > 1)[group]
    return [x.tobytes() for x in np.split(flags, np.cumsum(size)[:-1])]


def _searched(window):
    """Rows sorted by anchor: for each segment, a flag for each of its windows that occurs elsewhere."""

    def judge(rows):
        if len(rows["words"]) > AUTOMATON:
            return _counted(rows["words"], rows["copies"], window)
        sequences = [_hashes(x).view(np.int64).tolist() for x in rows["words"]]
        a = SuffixAutomaton()
        for s, n in zip(sequences, rows["copies"], strict=True):
            a.add(s, n)
        a.close()
        return [bytes(int(n >= window) for n in a.statistics(s)[window - 1 :]) for s in sequences]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows["anchor"], pa.int64()), pa.array(rows["fp"], pa.int64()), pa.array(judge(rows), pa.binary())], ["anchor", "fp", "flags"])

    def run(batches):
        held = {"anchor": [], "fp": [], "copies": [], "words": []}
        for batch in batches:
            for anchor, fp, copies, words in zip(*(batch[c].to_pylist() for c in ("anchor", "fp", "copies", "words")), strict=True):
                if held["anchor"] and held["anchor"][-1] != anchor:
                    yield out(held)
                    held = {"anchor": [], "fp": [], "copies": [], "words": []}
                held["anchor"].append(anchor), held["fp"].append(fp), held["copies"].append(copies), held["words"].append(words)
        if held["anchor"]:
            yield out(held)

    return run


def _windows(window):
    """Each window of each segment, by hash."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("anchor", "fp", "copies", "i", "w1", "w2")}
            for anchor, fp, copies, words in zip(*(batch[c].to_pylist() for c in ("anchor", "fp", "copies", "words")), strict=True):
                h = _hashes(words)
                g, k = w.grams(h, window), w.grams(w.mix(h), window)
                n = len(g)
                rows["anchor"].append(np.full(n, anchor)), rows["fp"].append(np.full(n, fp)), rows["copies"].append(np.full(n, copies)), rows["i"].append(np.arange(n))
                rows["w1"].append(g.view(np.int64)), rows["w2"].append(k.view(np.int64))
            if rows["fp"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in rows.values()], list(rows))

    return run


def _digest(window, spans: bool):
    """n_words, removed words, hash of the rest; removed spans come from the column ``found`` if there is one."""

    def run(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": []}
            found = batch["found"] if spans else None
            for b in w.blocks(batch["text"], w.NOT_SPACE, False, hashed=False):
                keep = np.ones(len(b.starts), bool)
                if spans:
                    edge = np.zeros(len(b.starts) + 1, np.int64)
                    for i in range(len(b)):
                        for x in found[b.first + i].as_py() or []:
                            if x["flags"] is None:
                                at = np.arange(x["windows"])
                            else:
                                at = np.flatnonzero(np.frombuffer(x["flags"], np.uint8))
                            at = b.at[i] + x["first"] + at
                            edge[at] += 1
                            np.subtract.at(edge, at + window, 1)
                    keep = np.cumsum(edge)[:-1] == 0
                doc = b.doc()
                data, inside = b.data.copy(), np.zeros(len(b.data) + 1, np.int8)
                s, e, d = b.starts[keep], b.ends[keep], doc[keep]
                inside[s] = 1
                inside[e] -= 1
                inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
                gap = e[:-1][d[1:] == d[:-1]] if len(e) else e
                data[gap] = 0x20
                inside[gap] = True
                n, left = b.counts(), np.bincount(d, minlength=len(b))
                text_at = batch_offsets(b, s, e, d)
                out["n_words"].append(n), out["n_removed"].append(n - left)
                out["kept_sha256"] += [hashlib.sha256(data[x:y][inside[x:y]].tobytes()).hexdigest() for x, y in text_at]
            n = [np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("n_words", "n_removed")]
            yield pa.RecordBatch.from_arrays([batch["d"], batch["f"], *map(pa.array, n), pa.array(out["kept_sha256"], pa.string())], ["d", "f", "n_words", "n_removed", "kept_sha256"])

    return run


def batch_offsets(b: w.Words, s: np.ndarray, e: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """For each text, the bytes from its first kept word to the end of its last; empty if it has none."""
    lo, hi = np.searchsorted(d, np.arange(len(b))), np.searchsorted(d, np.arange(len(b)), "right")
    return [(int(s[x]), int(e[y - 1])) if y > x else (0, 0) for x, y in zip(lo, hi, strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts anywhere else in the corpus, the same text
    included. Null texts have no words; texts shorter than a window lose nothing; repeated rows lose every word if they
    have a window. Rows without doc_id are treated alike.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d")
    docs = docs.select(key, F.xxhash64("text").alias("f"), "text")
    found = docs.mapInArrow(lean(_found(window)), _FOUND)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("fp") == F.max("fp")).alias("alike")).where("n > 1")
    anchors = scratch.save(anchors, "anchors")
    places = scratch.save(_Hot(anchors, ["anchor"], "n").join(found, anchors.drop("n")), "places")

    one = places.where("not alike").groupBy("anchor", "fp").agg(F.count("*").alias("copies"), F.min_by(F.struct("d", "f", "first", "windows"), F.struct("d", "f", "first")).alias("at"))
    one = scratch.save(one, "one")
    sizes = scratch.save(one.groupBy("anchor").agg(F.count("*").alias("size")), "sizes")
    sized = _Hot(sizes, ["anchor"], "size").join(one, sizes)
    wanted = sized.groupBy("at.d", "at.f").agg(F.collect_list(F.struct("anchor", "fp", "copies", "size", F.col("at.first").alias("first"), F.col("at.windows").alias("windows"))).alias("wanted"))
    texts = docs.withColumn("h", place("d", "f")).mapInArrow(lean(_texts(bitmap(one.select("at.d", "at.f"), "d", "f"), ["d", "f", "text"])), "d long, f long, text string")
    content = texts.dropDuplicates(["d", "f"]).join(wanted, ["d", "f"]).select("text", "wanted").mapInArrow(lean(_contents(window)), "anchor long, fp long, copies long, size long, words binary")
    content = scratch.save(content, "content")
    flags = content.where(F.col("size") <= LARGE).drop("size").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_searched(window)), "anchor long, fp long, flags binary")
    each = content.where(F.col("size") > LARGE).drop("size").mapInArrow(lean(_windows(window)), "anchor long, fp long, copies long, i long, w1 long, w2 long")
    again = each.groupBy("anchor", "w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1")
    hot = each.join(again, ["anchor", "w1", "w2"]).groupBy("anchor", "fp").agg(F.collect_list("i").alias("at"))
    hot = hot.select("anchor", "fp", F.transform(F.sequence(F.lit(0).cast("bigint"), F.array_max("at")), lambda i: F.when(F.array_contains("at", i), "01").otherwise("00")).alias("x"))
    flags = flags.unionByName(hot.select("anchor", "fp", F.unhex(F.array_join("x", "")).alias("flags")))
    flags = scratch.save(flags.where(F.instr(F.hex("flags"), "01") > 0), "flags")

    alike = places.where("alike").select("d", "f", "first", "windows", F.lit(None).cast("binary").alias("flags"))
    others = _Hot(one, ["anchor", "fp"], "copies").join(places.where("not alike"), flags).select("d", "f", "first", "windows", "flags")
    gone = alike.unionByName(others).groupBy("d", "f").agg(F.collect_set(F.struct("first", "windows", "flags")).alias("found"))
    gone = scratch.save(gone, "gone")
    scratch.drop("anchors", "places", "one", "sizes", "content", "flags")
    bits = bitmap(gone, "d", "f")
    schema = "d long, f long, n_words long, n_removed long, kept_sha256 string"
    keyed = docs.withColumn("h", place("d", "f"))
    same = keyed.mapInArrow(lean(_texts_not(bits)), "d long, f long, text string").mapInArrow(lean(_digest(window, False)), schema)
    maybe = keyed.mapInArrow(lean(_texts(bits, ["d", "f", "text"])), "d long, f long, text string").join(gone, ["d", "f"], "left").mapInArrow(lean(_digest(window, True)), schema)
    return same.unionByName(maybe).select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _texts_not(bits):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~passes(bits.value, batch["h"].to_numpy()))).select(["d", "f", "text"])

    return run
