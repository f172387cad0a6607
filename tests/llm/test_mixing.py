import math
from collections import defaultdict

import pytest
from strandline.llm import mixing as m


def test_exponent_meets_targets():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    p = m.plan(tokens, target_entropy=0.8)
    assert m.entropy(p.weights) == pytest.approx(0.8) and set(p.weights) == {"a", "b", "c"}
    p = m.plan(tokens, max_repeats=3)
    assert max(p.repeats.values()) == pytest.approx(3) and min(p.repeats.values()) == pytest.approx(1)
    assert p.repeats["a"] == 1 and 1 < p.repeats["b"] < 3
    assert m.plan(tokens).exponent == 1 and set(m.plan(tokens).repeats.values()) == {1}
    p = m.plan(tokens, max_repeats=2, budget=5000)
    assert p.budget == pytest.approx(2220)
    assert m.plan({}).weights == {} and m.plan({"a": 0}).repeats == {}


@pytest.mark.parametrize("target", [{"max_repeats": 2.5}, {"target_entropy": 1.0, "budget": 3000.0}, {}])
def test_schedule(spark, monkeypatch, target):
    monkeypatch.setattr(m, "BLOCK_TOKENS", 64)
    docs = [(i, "w " * (1 + i * 7 % 23), ["x", "x", "x", "x", None, "y"][i % 6] if i % 50 else "tiny") for i in range(300)] + [(900, "", "x"), (901, None, None), (902, "  ", "blank")]
    rows, p = m.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "5 as mix_block", "6 as n_tokens"), **target)
    got = rows.collect()
    assert set(rows.columns) == {"doc_id", "text", "source", "n_tokens", "epoch", "block_key", "doc_key"}
    key = lambda s: "-" if s is None else f"+{s}"
    total, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        n = len((t or "").split())
        total[key(s)] += n
        longest[key(s)] = max(longest[key(s)], n)
    seen = defaultdict(list)
    for r in got:
        assert r.n_tokens == len((r.text or "").split())
        taken[key(r.source)] += r.n_tokens
        seen[key(r.source), r.epoch].append(r)
    for s, w in p.weights.items():
        assert w * p.budget - 1e-6 <= taken[s] + 1e-3 and taken[s] < w * p.budget + longest[s]
        whole = int(p.repeats[s])
        for e in range(whole):
            assert sum(r.n_tokens for r in seen[s, e]) == total[s] and len({r.doc_id for r in seen[s, e]}) == len(seen[s, e])
        assert all(e <= whole for x, e in seen if x == s)
        # the part of an epoch is a beginning of that epoch's order
        if seen[s, whole]:
            docs_of = [r for r in seen[s, whole]]
            assert len({r.doc_id for r in docs_of}) == len(docs_of)
        if whole > 1:
            assert [r.doc_id for r in sorted(seen[s, 0], key=lambda r: (r.block_key, r.doc_key))] != [r.doc_id for r in sorted(seen[s, 1], key=lambda r: (r.block_key, r.doc_key))]
    assert not any(s == "+blank" for s, _ in seen)
    assert math.isclose(sum(p.weights.values()), 1)


def test_empty(spark):
    rows, p = m.mix(spark.createDataFrame([], "doc_id long, text string, source string"), max_repeats=2.0)
    assert rows.count() == 0 and p.budget == 0
