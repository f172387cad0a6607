import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import substrings as s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.integers(1, 3)), min_size=1, max_size=4))
def test_automaton(texts):
    a = s.SuffixAutomaton()
    for x, n in texts:
        a.add(x, n)
    a.close()

    def occurs(y):
        return sum(n * sum(x.startswith(y, i) for i in range(len(x))) for x, n in texts)

    for x, _ in texts:
        want = [max((k for k in range(i + 2) if k == 0 or occurs(x[i + 1 - k : i + 1]) >= 2)) for i in range(len(x))]
        assert a.statistics(x) == want


def made(seed):
    r = random.Random(seed)
    text = lambda n: [r.choice("abcdefghijklmnopqrs") for _ in range(n)]
    shared = [text(r.randint(8, 60)) for _ in range(6)]
    docs = []
    for i in range(60):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            x = r.choice(shared)
            k = r.randrange(4)
            t += x[k:] + text(r.randint(0, 5))
        docs.append((i, "  ".join(t) + "\n"))
    docs += [(100, None), (101, ""), (102, " ".join(["same"] * 50)), (103, " ".join(text(3)) + "\té Ü")]
    return docs + [docs[5], (300, docs[7][1])]


@pytest.mark.parametrize(("seed", "window", "automaton", "large"), [(1, 12, 500, 1000), (2, 9, 1, 1), (3, 5, 1, 1000), (4, 5, 2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, window, automaton, large):
    monkeypatch.setattr(s, "AUTOMATON", automaton)
    monkeypatch.setattr(s, "LARGE", large)
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as d", "2 as f", "3 as anchor").repartition(3)
    got = sorted(tuple(r) for r in s.remove_repeats(df, window).collect())
    assert got == sorted(brute.repeats_removed(docs, window))


def test_null_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long), (1, long + " end"), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in s.remove_repeats(docs).collect())
    assert got == [(0, 1, 0), (0, 40, 40), (1, 41, 40)]
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_hot_keys_are_dealt(spark):
    # a third of the rows, all equal, share key 7; the others have a key each
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id + 10) as k", "if(id % 3 = 0, 0, id) as x").repartition(8)
    one = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as y")
    hot = s._Hot(one, ["k"], "n")
    parts = {r.k: r.parts for r in hot.parts.collect()}
    assert parts[7] == s.PARTS // 3
    assert sum(parts.values()) <= s.PARTS
    joined = hot.join(rows, one.drop("n"))
    assert joined.columns == ["k", "x", "y"]
    assert sorted(map(tuple, joined.collect())) == sorted((r.k, r.x, r.k * 2) for r in rows.collect())
    assert hot.join(rows.limit(0), one).count() == 0
    assert not s._Hot(one.limit(0), ["k"], "n").parts.count()
