"""Near-duplicate texts by a chosen-path set similarity join.

A text's set is its distinct shingles (5 words). Equal sets are one class, kept as one representative. Each
representative has ``WIDTH`` minwise tokens. In each of ``TREES`` independent trees it follows, at every node, the
coordinates that a hash of the node chooses; the node reached is named by the path of (coordinate, minwise token) pairs.
With ``BRANCH`` = 2 paths a node, texts of similarity s share a node at depth d of one tree with probability q(d),
q(0) = 1, q(d + 1) = 1 - (1 - s q(d)) ^ 2: over 0.88 at any depth for s = 0.75, hence below 1e-5 to be missed by all
trees. From depth ``WIDE`` on, a node has a second path with probability 1 / ``RATE`` only, so that texts of a similarity
below the threshold part in the end and the work stays in proportion to the number of texts.

Work is by nodes, and linear in their size until few texts are left:

1. Every member of a node is estimated against the node's first ``PIVOTS`` members (in one order for all nodes), the best
   candidate of each text is confirmed on full sets, and components are formed. This goes on for nodes over ``SMALL``,
   with heads of their largest components as pivots, while it halves the rows of nodes that hold several components.
2. In nodes that still hold several components, members of different ones are compared exhaustively, first by estimates,
   then on full sets. A pair that meets in several nodes is compared in the first of them only.

A task holds ``HELD`` members at once (signatures of 1 MB). Nodes of up to ``BLOCKS`` / 2 times that are dealt by hash into
blocks of about half of it: stars are within blocks, and what is left is compared in all pairs of blocks. That repeats a
member once for each other block; branching repeats it in two nodes for each level, and in every tree. Still larger nodes
are starred as tables and, if they still hold several components, branch further, to any depth.
Comparisons by the minwise estimate leave out pairs over 4 standard deviations below the threshold; full sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from ..runtime import Scratch, ship
from . import words as w
from .bitmap import BITS, bitmap, passes, place
from .lean import free, lean

SHINGLE, THRESHOLD = 5, 75
TREES, BRANCH, START, SMALL, WIDTH = 6, 2, 2, 64, 128
WIDE, RATE = 4, 3
HELD, BLOCKS, PIVOTS, SALTS = 2048, 16, 16, 32
ESTIMATE = 0.58
U = w.U
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, WIDTH, dtype=U) * U(2) + U(1)
_B = _rng.integers(0, 2**64, WIDTH, dtype=U)


def shingle_sets(batch_col, size: int = SHINGLE):
    """For each text of an Arrow column, its sorted distinct shingle hashes; shorter texts have their whole sequence."""
    for b in w.blocks(batch_col, w.NOT_SPACE, True):
        n = b.counts()
        g = w.grams(b.hashes, size)
        for i in range(len(b)):
            if n[i] >= size:
                yield np.unique(g[b.at[i] : b.at[i + 1] - size + 1])
            elif n[i]:
                yield w.grams(b.hashes[b.at[i] : b.at[i + 1]], int(n[i]))
            else:
                yield np.zeros(0, U)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(WIDTH, np.iinfo(U).max, U)
    for k in range(0, len(s), 2048):
        np.minimum(out, (s[k : k + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return (out >> U(32)).astype(np.uint32)


def _sketch(batches):
    for batch in batches:
        n, f1, f2, sig = [], [], [], []
        for s in shingle_sets(batch["text"]):
            a, b = w.set_fingerprint(s)
            n.append(len(s)), f1.append(a), f2.append(b)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n", "f1", "f2", "sig"])


def _matrix(col) -> np.ndarray:
    raw, offs = w.column_bytes(col)
    return raw.view(np.uint32).reshape(len(offs) - 1, WIDTH) if len(raw) else np.zeros((0, WIDTH), np.uint32)


def _below(node: np.ndarray, k: int) -> np.ndarray:
    """The coordinate by which path ``k`` leaves each node."""
    first = w.mix(node ^ U(0x51ED270B4D2F1C35))
    c = first % U(WIDTH)
    for j in range(1, k + 1):  # another coordinate than the one before
        c = (c + U(1) + w.mix(first + U(j)) % U(WIDTH - 1)) % U(WIDTH)
    return c


def _named(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return w.mix(node * U(0x9E3779B97F4A7C15) + w.mix(coordinate << U(32) | token))


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """For each (node, signature), the BRANCH nodes below."""
    out = np.empty((len(node), BRANCH), U)
    for k in range(BRANCH):
        c = _below(node, k)
        out[:, k] = _named(node, c, sig[np.arange(len(node)), c.astype(np.int64)].astype(U))
    return out


def _paths(sig: np.ndarray) -> np.ndarray:
    """(texts, nodes) at depth START of all trees."""
    node, who = np.tile(w.mix(np.arange(1, TREES + 1, dtype=U)), len(sig)), np.repeat(np.arange(len(sig)), TREES)
    for _ in range(START):
        node, who = _children(node, sig[who]).ravel(), who.repeat(BRANCH)
    return node.reshape(len(sig), -1)


def _roots(batches):
    for batch in batches:
        node = _paths(_matrix(batch["sig"]))
        yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(batch["rep"].to_numpy().repeat(node.shape[1]))], ["node", "rep"])


def _branches(depth: int):
    """The nodes below those of one depth."""

    def run(batches):
        for batch in batches:
            node = batch["node"].to_numpy().view(U)
            below = _children(node, _matrix(batch["sig"]))
            second = np.full(len(node), True) if depth < WIDE else w.mix(node ^ U(0x2127599BF4325C37)) % U(RATE) == 0
            rep = batch["rep"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([below[:, 0], below[second, 1]]).view(np.int64)), pa.array(np.concatenate([rep, rep[second]]))], ["node", "rep"])

    return run


def _close(batches):
    """Rows whose two signatures let the threshold be reached."""
    for batch in batches:
        est = (_matrix(batch["sa"]) == _matrix(batch["sb"])).mean(axis=1)
        keep = pa.array(est >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(est)], ["a", "b", "est"]).filter(keep)


def _by_group(judge, rows: int = 4096):
    """Runs ``judge`` on tables of whole groups, from rows sorted by g. Holds one group and about ``rows`` rows."""

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, len(batch), rows):
                t = pa.Table.from_batches([batch.slice(at, rows)])
                t = pa.concat_tables([held, t]) if held is not None and len(held) else t
                g = t["g"].to_numpy()
                last = int(np.searchsorted(g, g[-1]))
                if last:
                    yield from judge(t.slice(0, last).combine_chunks()).to_batches()
                held = t.slice(last)
        if held is not None and len(held):
            yield from judge(held.combine_chunks()).to_batches()

    return lean(run)


def _candidates(pivots: int):
    """For each row of a group, its likeliest partner of another component among the group's pivots. Pivots are the first
    members of the group's components, largest components first, then other members; each row looks at pivots before it."""

    def judge(t: pa.Table) -> pa.Table:
        g, rep, comp, sig = t["g"].to_numpy(), t["rep"].to_numpy(), t["comp"].to_numpy(), _matrix(t["sig"])
        h = w.mix(rep.view(U) + U(0x632BE59BD9B4E019))
        by = np.lexsort((h, comp, g))
        new = np.append(True, (comp[by][1:] != comp[by][:-1]) | (g[by][1:] != g[by][:-1]))
        size, head = np.empty(len(g), np.int64), np.empty(len(g), bool)
        size[by], head[by] = np.diff(np.append(np.flatnonzero(new), len(g)))[np.cumsum(new) - 1], new
        by = np.lexsort((h, -size, ~head, g))
        g, rep, comp, sig = g[by], rep[by], comp[by], sig[by]
        start = np.searchsorted(g, g)
        rank = np.arange(len(g)) - start
        best, partner = np.zeros(len(g)), np.full(len(g), -1)
        for j in range(pivots):
            row = np.flatnonzero(rank > j)
            row = row[comp[row] != comp[start[row] + j]]
            if not len(row) and not (rank > j).any():
                break
            est = (sig[row] == sig[start[row] + j]).mean(axis=1)
            more = est > best[row]
            best[row[more]], partner[row[more]] = est[more], start[row[more]] + j
        ok = np.flatnonzero(best >= ESTIMATE)
        return pa.table([pa.array(rep[partner[ok]]), pa.array(rep[ok]), pa.array(best[ok])], ["a", "b", "est"])

    return judge


def _blocks(t: pa.Table) -> np.ndarray:
    """For each row, its block if another group compares that block within itself, else 0."""
    return t["block"].to_numpy() if "block" in t.column_names else np.zeros(len(t), np.int32)


def _closeness(large):
    """Members that are close to a member of another component of their group, a node or two blocks of one. A pair counts in
    the first node of depth START that holds both and is certainly not one that branched (``large``: a bitmap of those, or
    None); if there is none, in all."""

    def judge(t: pa.Table) -> pa.Table:
        g, comp, sig, keep = t["node" if "node" in t.column_names else "g"].to_numpy().view(U), t["comp"].to_numpy(), _matrix(t["sig"]), np.zeros(len(t), bool)
        block = _blocks(t)
        paths, end = _paths(sig), np.searchsorted(t["g"].to_numpy(), t["g"].to_numpy(), "right")
        sure = np.ones(paths.shape, bool) if large is None else ~passes(large.value, (paths & U(BITS - 1)).astype(np.int64))
        top = (paths == g[:, None]).any(axis=1)
        rows, d = np.arange(len(t)), 1
        while len(rows := rows[rows + d < end[rows]]):
            a = rows[(comp[rows] != comp[rows + d]) & ((block[rows] != block[rows + d]) | (block[rows] == 0))]
            for k in range(0, len(a), 1 << 16):
                x = a[k : k + (1 << 16)]
                x = x[(sig[x] == sig[x + d]).mean(axis=1) >= ESTIMATE]
                both = (paths[x] == paths[x + d]) & sure[x]
                first = both.argmax(axis=1)
                x = x[~both.any(axis=1) | (paths[x, first] == g[x]) | ~top[x]]
                keep[x] = keep[x + d] = True
            d += 1
        return t.select(["g", "rep", "comp"]).append_column("block", pa.array(block)).filter(pa.array(keep))

    return judge


def _linked(t: pa.Table) -> pa.Table:
    """Links between components, as many as join what can be joined: no pair of members already joined here is compared."""
    g, rep, label, block = t["g"].to_numpy(), t["rep"].to_numpy(), t["comp"].to_numpy().copy(), _blocks(t)
    raw, offs = w.column_bytes(t["shingles"])
    sets = [np.frombuffer(raw[a:b].tobytes(), U) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    sig = np.stack([signature(s) for s in sets])
    size, out = np.diff(offs) // 8, []
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        for i in range(lo, hi - 1):
            near = i + 1 + np.flatnonzero((label[i + 1 : hi] != label[i]) & (100 * np.minimum(size[i + 1 : hi], size[i]) >= THRESHOLD * np.maximum(size[i + 1 : hi], size[i])))
            near = near[(block[near] != block[i]) | (block[near] == 0)]
            near = near[(sig[near] == sig[i]).mean(axis=1) >= ESTIMATE]
            for k in range(0, len(near), 64):
                js = near[k : k + 64]
                js = js[label[js] != label[i]]
                if not len(js):
                    continue
                at, both = np.cumsum(size[js]) - size[js], np.concatenate([sets[j] for j in js])
                k_ = np.minimum(np.searchsorted(sets[i], both), size[i] - 1)
                n = np.add.reduceat((sets[i][k_] == both).astype(np.int64), at)
                for j in js[100 * n >= THRESHOLD * (size[js] + size[i] - n)]:
                    if label[j] != label[i]:
                        out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                        mine = label[lo:hi]
                        mine[mine == label[j]] = label[i]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(bits):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch["h"].to_numpy())))
            if len(batch):
                sets = list(shingle_sets(batch["text"]))
                f1 = pa.array([w.set_fingerprint(s)[0] for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], f1, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "f1", "shingles"])

    return lean(run)


def _agree(threshold):
    def run(batches):
        for batch in batches:
            keep = []
            (ra, oa), (rb, ob) = w.column_bytes(batch["xa"]), w.column_bytes(batch["xb"])
            for i in range(len(batch)):
                x, y = (np.frombuffer(r[o[i] : o[i + 1]].tobytes(), U) for r, o in ((ra, oa), (rb, ob)))
                n = int((np.searchsorted(y, x, "right") > np.searchsorted(y, x, "left")).sum()) if len(y) else 0
                keep.append(100 * n >= threshold * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


class _Join:
    """The state of one join: representatives, the links found so far, and the components that they make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch):
        self.docs, self.reps, self.scratch = docs, reps, scratch
        self.sigs, self.links, self.comp, self.step = reps.select("rep", "sig"), None, None, 0

    def labelled(self, members: DataFrame) -> DataFrame:
        """(node, rep, comp, size)"""
        if self.comp is None:
            return members.select("node", "rep", F.col("rep").alias("comp"), "size")
        return members.join(self.comp.toDF("rep", "label"), "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("comp"), "size")

    def mixed(self, members: DataFrame) -> DataFrame:
        """(node, rep, comp, size) of the nodes that hold several components."""
        rows = self.scratch.save(self.labelled(members), f"labelled_{self.step}")
        some = rows.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        out = self.scratch.save(rows.join(some, "node", "left_semi"), f"mixed_{self.step}")
        self.scratch.drop(f"labelled_{self.step}")
        self.step += 1
        return out

    def left(self, members: DataFrame) -> int:
        """How many rows of ``members`` are in nodes that hold several components."""
        some = self.labelled(members).groupBy("node").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        return some.agg(F.sum("rows")).first()[0] or 0

    def grouped(self, rows: DataFrame, pairs: bool = False) -> DataFrame:
        """(g, rep, comp, sig), whole groups in one partition, in order. Groups are nodes; of nodes that a task cannot hold,
        their blocks or, with ``pairs`` (adds node and block), all pairs of their blocks."""
        count = F.ceil(F.col("size") * 2 / HELD).cast("int")
        rows = rows.join(self.sigs, "rep").withColumn("own", F.when(F.col("size") > HELD, F.pmod(F.xxhash64("rep", "node"), count).cast("int")))
        part = F.when(F.col("own").isNull(), F.col("node"))
        if not pairs:
            rows = rows.select(part.otherwise(F.xxhash64("node", "own")).alias("g"), "rep", "comp", "sig")
            return rows.repartition("g").sortWithinPartitions("g")
        others = F.array_except(F.sequence(F.lit(0), count - 1), F.array("own"))
        rows = rows.withColumn("other", F.explode(F.when(F.col("own").isNull(), F.array(F.lit(0))).otherwise(others)))
        # a block is compared within itself beside the next one, the last beside the one before
        within = F.col("own").isNull() | (F.col("other") == F.least(F.col("own") + 1, count - 1)) | ((F.col("own") == count - 1) & (F.col("other") == count - 2))
        g = part.otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
        rows = rows.select(g.alias("g"), "node", "rep", "comp", F.when(within, 0).otherwise(F.col("own") + 1).cast("int").alias("block"), "sig")
        return rows.repartition("g").sortWithinPartitions("g")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(rep, shingles) of some representatives. A bitmap of fixed size keeps most other texts from going over the
        network; an exact join follows it, so the bitmap decides nothing."""
        ids = self.scratch.save(ids.toDF("rep").distinct().join(self.reps.select("rep", "doc_id", "f1"), "rep"), f"{name}_ids")
        found = self.docs.where("doc_id is not null").select("doc_id", "text", place("doc_id").alias("h")).mapInArrow(_sets(bitmap(ids, "doc_id")), "doc_id long, f1 long, shingles binary")
        return self.scratch.save(found.join(ids, ["doc_id", "f1"]).dropDuplicates(["rep"]).select("rep", "shingles"), f"{name}_sets")

    def confirm(self, candidates: DataFrame) -> None:
        """Of (a, b, est), takes the likeliest a of each b, confirms it on full sets, and forms components anew. A much wanted
        a is salted."""
        name = f"round_{self.step}"
        best = candidates.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
        best = self.scratch.save(best.select("a", "b"), name)
        sets = self.sets(best.select(F.explode(F.array("a", "b"))), name)
        salts = best.groupBy("a").agg(F.ceil(F.count("*") / 1024).cast("int").alias("salts"))
        left = salts.join(sets.toDF("a", "xa"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        pairs = best.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
        full = pairs.join(sets.toDF("b", "xb"), "b").join(left.drop("salts"), ["a", "salt"]).select("a", "b", "xa", "xb")
        found = self.scratch.save(full.mapInArrow(_agree(THRESHOLD), "a long, b long"), f"{name}_links")
        self.scratch.drop(name, f"{name}_ids", f"{name}_sets")
        self.add(found, name)

    def add(self, links: DataFrame, name: str) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)
        self.comp = self.scratch.save(components(self.links, self.scratch, f"{name}_cc"), f"{name}_comp")
        free()  # of the driver, which has planned many small jobs

    def star(self, large: DataFrame) -> None:
        """One round over nodes that no task can hold: all members against a few pivots of their node, salted."""
        rows = self.labelled(large)
        salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
        heads = rows.groupBy("node").agg(F.array_distinct(F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(k + self.step))) for k in range(4)))).alias("a"))
        heads = heads.select("node", F.explode("a").alias("rep")).join(self.sigs, "rep").toDF("a", "node", "sa").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = rows.withColumn("salt", salt).join(heads, ["node", "salt"]).where("a <> rep").select("a", F.col("rep"), "sa")
        pairs = pairs.join(self.sigs, "rep").select("a", F.col("rep").alias("b"), "sa", F.col("sig").alias("sb"))
        self.confirm(pairs.mapInArrow(lean(_close), "a long, b long, est double"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null or empty texts have no shingles and are linked with nothing. Rows without doc_id have component null and are
    kept. Rows that repeat a doc_id are judged each by its own text, whatever their order; text_hash tells those apart.
    Rows with equal id and text have equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lean(_sketch), "doc_id long, text_hash long, n long, f1 long, f2 long, sig binary")
    rows = scratch.save(rows, "rows")
    some = rows.where("n > 0 and doc_id is not null")
    reps = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    # sets of ids with several texts get names of their own
    several = some.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("low"), F.max(F.struct("f1", "f2", "n")).alias("high")).where("low <> high").select("doc_id")
    several = scratch.save(several, "several")
    clash = not several.isEmpty()
    if clash:
        own = F.when(F.col("s").isNotNull(), -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "f1", "f2", "n"), 2)).otherwise(F.col("doc_id"))
        reps = reps.join(several.withColumn("s", F.lit(1)), "doc_id", "left").withColumn("rep", own).drop("s")
    else:
        reps = reps.withColumn("rep", F.col("doc_id"))
    reps = scratch.save(reps, "reps")
    join = _Join(docs, reps, scratch)

    # nodes that a task can hold, whole or by blocks; larger ones branch further, unless they are one component
    nodes, held, depth, bits = reps.select("rep", "sig").mapInArrow(lean(_roots), "node long, rep long"), None, START, None
    while True:
        nodes = scratch.save(nodes, f"nodes_{depth}")
        size = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        full = scratch.save(nodes.join(size, "node"), f"full_{depth}")
        scratch.drop(f"nodes_{depth}")
        most = HELD * BLOCKS // 2
        part, large = full.where(F.col("size") <= most), full.where(F.col("size") > most)
        held = part if held is None else held.unionByName(part)
        if large.isEmpty():
            break
        if depth == START:
            bits = bitmap(large, at=F.col("node").bitwiseAND(F.lit(BITS - 1)))
        join.star(large)
        nodes = join.mixed(large).join(join.sigs, "rep").select("node", "rep", "sig").mapInArrow(lean(_branches(depth)), "node long, rep long")
        depth += 1

    # stars within nodes or blocks; those of large nodes again and again while that helps, the first round included
    link, some = "a long, b long, est double", held.where(F.col("size") > SMALL)
    now, n = join.labelled(held) if join.comp is None else join.mixed(held), join.left(some)
    while True:
        join.confirm(join.grouped(now).mapInArrow(_by_group(_candidates(PIVOTS)), link))
        before, n = n, join.left(some)
        if not 0 < n <= before / 2:
            break
        now = join.mixed(some)

    # what is left is compared node by node
    rest = scratch.save(join.grouped(join.mixed(held), pairs=True).mapInArrow(_by_group(_closeness(bits)), "g long, rep long, comp long, block int"), "rest")
    full = rest.join(join.sets(rest.select("rep"), "rest"), "rep").repartition("g").sortWithinPartitions("g").select("g", "rep", "comp", "block", "shingles")
    more = scratch.save(full.mapInArrow(_by_group(_linked, 256), "a long, b long"), "more_links")
    join.add(more, "last")
    ids = join.comp.toDF("rep", "component")
    whose = reps.select("f1", "f2", "n", "rep", "doc_id").join(ids, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if clash:
        least = whose.groupBy("component").agg(F.min("doc_id").alias("least"))
        whose = whose.join(least, "component").withColumn("component", F.col("least"))
    whose = whose.select("f1", "f2", "n", "component")
    out = rows.select("doc_id", "text_hash", "n", "f1", "f2").join(whose, ["f1", "f2", "n"], "left")
    scratch.drop("rest", "rest_ids", "rest_sets", *(f"full_{d}" for d in range(START, depth + 1)), *(f"mixed_{k}" for k in range(join.step)))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
