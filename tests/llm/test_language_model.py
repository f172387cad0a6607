import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from strandline.llm import language_model as lm


def made():
    r = random.Random(2)
    nxt = {w: [f"{w}{k}"[-2:] for k in range(3)] for w in "abcdefgh"}
    docs = []
    for i in range(150):
        t, x = [], "a"
        for _ in range(r.randint(0, 40)):
            x = r.choice("abcdefgh") if r.random() < 0.3 or x not in nxt else r.choice(nxt[x])
            t.append(x.upper() if r.random() < 0.1 else x)
        docs.append((i, " ".join(t)))
    return docs + [(500, None), (501, ""), (502, "rare"), (503, "a b " * 5000)] + docs[:2]


@pytest.mark.parametrize(("slice_bytes", "range_bytes"), [(1 << 20, 1 << 20), (400, 3000)])
def test_base_and_model(spark, monkeypatch, slice_bytes, range_bytes):
    monkeypatch.setattr(lm, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lm, "RANGE_BYTES", range_bytes)
    docs = made()
    out = lm.score(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as part", "2 as slice")).toPandas()
    c, held = Counter(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: brute.SPACED.findall((t or "").translate(brute.LOWER)) + ["\n"] for i, t in docs}
    for i, t in docs:
        if not held(i):
            c.update(tokens[i])
    n, v = sum(c.values()), len(c)
    assert len(out) == len(docs)
    for r in out.itertuples():
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ts), sum(c[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + (v + 1))) for x in ts), rel=1e-9)
    some = out[out.held_out & (out.doc_id < 500)]
    assert some.score.sum() > some.base_score.sum()
    # same whatever the slices
    assert out.score.sum() == pytest.approx(test_base_and_model.__dict__.setdefault("total", out.score.sum()), rel=1e-9)


def test_weights_follow_the_held_out_counts():
    cells = np.array([[3, 0, -48, -72, 900], [3, 1, -48, -72, 100], [5, 1, -24, -48, 50]])
    x = lm.learn(cells)
    assert x[3, 0] > 0.8 and x[5, 1] > 0.8 and np.allclose(x.sum(axis=1), 1)


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm._unpack(lm._pack(x)) == x).all()
    for top in (1, 200, 70_000, 1 << 40):
        c = np.arange(top - 1, top + 5)
        assert (lm._unpack_counts(lm._pack_counts(c)) == c).all()
    assert len(lm._unpack(lm._pack(x[:0]))) == 0


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_scores(docs):
    """Every text's score by dictionaries and loops."""
    tokens = [brute.SPACED.findall((t or "").translate(brute.LOWER)) + ["\n"] for _, t in docs]
    fold = [zlib.crc32(str(i).encode()) % 7 for i, _ in docs]
    main, tune = (Counter(), Counter()), (Counter(), Counter())
    for ts, f in zip(tokens, fold, strict=True):
        if f != 2:
            one, two = tune if f == 5 else main
            one.update(ts)
            two.update(zip(["\n", *ts], ts, strict=False))

    def estimates(ts, one, two, n, v):
        for a, b in zip(["\n", *ts], ts, strict=False):
            p = (two[a, b] / max(one[a], 1), one[b] / max(n, 1), (one[b] + 1) / (n + v + 1))
            yield min(math.ceil(math.log2(one[a] + 1)), lm.BUCKETS - 1), p

    cells = Counter()
    for ts, f in zip(tokens, fold, strict=True):
        if f == 5:
            for bucket, p in estimates(ts, *main, sum(main[0].values()), len(main[0])):
                cells[bucket, tuple(round(math.log10(x) * lm.GRID) if x else None for x in p)] += 1

    def fitted(some):
        x = [1 / 3] * 3
        for _ in range(lm.STEPS):
            total = [0.1] * 3
            for (_, bins), n in some:
                share = [w * (10 ** (b / lm.GRID) if b is not None else 0) for w, b in zip(x, bins, strict=True)]
                total = [t + n * s / sum(share) for t, s in zip(total, share, strict=True)]
            x = [t / sum(total) for t in total]
        return x

    rest = fitted(list(cells.items()))
    weights = {k: fitted([c for c in cells.items() if c[0][0] == k]) for k in {k for k, _ in cells}}
    one, two = main[0] + tune[0], main[1] + tune[1]
    n, v = sum(one.values()), len(one)
    return [sum(math.log10(sum(w * x for w, x in zip(weights.get(b, rest), p, strict=True))) for b, p in estimates(ts, one, two, n, v)) for ts in tokens]


def test_scores_against_a_plain_version(spark):
    docs = made()
    out = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).toPandas().drop_duplicates("doc_id").set_index("doc_id").score
    want = dict(zip([i for i, _ in docs], plain_scores(docs), strict=True))
    for i, x in want.items():
        assert out[i] == pytest.approx(x, rel=1e-9), i


def test_rows_without_id_are_trained_on(spark):
    rows = [(None, "a b"), (None, None), (1, "a b")]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 3 and all(r.train_tokens == out[0].train_tokens >= 4 for r in out)
