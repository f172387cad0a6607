import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from strandline.llm import near_dups


def made(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeX") for _ in range(r.randint(2, 5)))
    docs, i = [], 0
    common = [word() for _ in range(12)]
    for g in range(12):
        base = [word() for _ in range(r.randint(6, 120))]
        for _ in range(r.choice([1, 2, 8])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = word()
            docs.append((i, " ".join(t + common * (g % 2))))
            i += 1
    docs += [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "ONE\ttwo"), (i + 4, " \n "), (i + 5, " ".join(word() for _ in range(30000)))]
    return docs


def test_against_brute_force(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as n", "'x' as sig")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("held", [3, 2048])
def test_large_nodes(spark, monkeypatch, held):
    """Nodes beyond the size that is compared at once, and beyond what a task holds, lose nothing."""
    monkeypatch.setattr(near_dups, "SMALL", 2)
    monkeypatch.setattr(near_dups, "HELD", held)
    monkeypatch.setattr(near_dups, "PIVOTS", 2)
    docs = made(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(docs)


def chain(n, seed=1):
    """Texts of one cluster that hang together by neighbours only, and strangers that share half of their words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text, docs = [word() for _ in range(150)], []
    for i in range(n):
        docs.append((i, " ".join(text)))
        k = r.randrange(150)
        text[k : k + 3] = [word() for _ in range(len(text[k : k + 3]))]
        if i % 10 == 9:
            docs.append((n + i, " ".join(text[:75] + [word() for _ in range(75)])))
    return docs


def test_a_long_chain_with_the_defaults(spark):
    docs = chain(300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near_duplicates(docs)


def test_rounds_that_join_nothing_end(spark, monkeypatch):
    """Strangers that share a passage stay in their nodes: they are not dealt again before the comparison of the rest."""
    r, dealt = random.Random(2), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    docs = [(i, " ".join(common + [word() for _ in range(40)])) for i in range(120)]
    mixed = near_dups._Join.mixed
    monkeypatch.setattr(near_dups._Join, "mixed", lambda self, members: dealt.append(mixed(self, members)) or dealt[-1])
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert all(x.component_id == x.doc_id for x in got.collect()) and len(dealt) == 1


def variants(n, seed=4):
    """Texts of one origin, most of them a little too far from each other to be linked."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, docs = [word() for _ in range(150)], []
    for i in range(n):
        text = list(base)
        for k in r.sample(range(150), r.choice([1, 4, 5, 6])):
            text[k] = word()
        docs.append((i, " ".join(text)))
    return docs


def test_a_large_group_is_dealt_by_blocks(spark, monkeypatch):
    """Rows of mixed nodes stay in proportion to the texts while blocks suffice, and nothing is lost."""
    monkeypatch.setattr(near_dups, "HELD", 32)
    docs, dealt = variants(160), []
    mixed = near_dups._Join.mixed
    monkeypatch.setattr(near_dups._Join, "mixed", lambda self, members: dealt.append(mixed(self, members)) or dealt[-1])
    grouped, rows = near_dups._Join.grouped, []
    monkeypatch.setattr(near_dups._Join, "grouped", lambda self, some, **kw: rows.append(some.count()) or grouped(self, some, **kw))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute.near_duplicates(docs)
    assert got == want and 3 < len({c for _, c in want.values()}) < 157
    assert len(dealt) == 1 and max(rows) <= near_dups.TREES * near_dups.BRANCH**near_dups.START * len(docs)


def test_each_pair_of_a_node_dealt_by_blocks_meets_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HELD", 8)
    for n in (8, 9, 30):
        reps = spark.createDataFrame([(i, b"") for i in range(n)], "rep long, sig binary")
        join = near_dups._Join(None, reps, None)
        rows = reps.selectExpr("7L as node", "rep", "rep as comp", f"{n}L as size")
        met = np.zeros((n, n), int)
        for _, t in join.grouped(rows, pairs=True).toPandas().groupby("g"):
            for i, x in zip(t["rep"], t["block"], strict=True):
                for j, y in zip(t["rep"], t["block"], strict=True):
                    met[i, j] += i < j and (x != y or x == 0)
        assert (met == np.triu(np.ones((n, n), int), 1)).all()
        dealt = [r.rep for r in join.grouped(rows).collect()]
        assert sorted(dealt) == list(range(n))


def test_each_close_pair_counts_in_one_node():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 32, near_dups.WIDTH, dtype=np.uint32)
    sig = np.where(r.random((40, near_dups.WIDTH)) < 0.12, r.integers(0, 1 << 32, (40, near_dups.WIDTH), dtype=np.uint32), base)
    paths = near_dups._paths(sig).view(np.int64)
    met = np.zeros((40, 40), int)
    for node in np.unique(paths):
        here = np.flatnonzero((paths == node).any(axis=1))
        for i in here:
            for j in here[here > i]:
                t = pa.table({"g": [node] * 2, "rep": [i, j], "comp": [i, j], "sig": [sig[i].tobytes(), sig[j].tobytes()]})
                met[i, j] += len(near_dups._closeness(None)(t)) // 2
    close = np.triu((sig[:, None] == sig[None]).mean(axis=2) >= near_dups.ESTIMATE, 1)
    shared = (paths[:, None] == paths[None]).any(axis=2)
    assert (met == (close & shared)).all() and met.sum() > 500


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a B c d e f"), (None, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_one_id_with_several_texts(spark):
    """Each row is judged by its own text, in whatever order rows come."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(5, text("a")), (5, text("b")), (3, text("a")), (4, text("b")), (6, text("c")), (5, "")]
    for some in (rows, rows[::-1]):
        got = near_dups.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.n_shingles) == [(3, 3), (4, 4), (5, 3), (5, 4), (6, 6)]
