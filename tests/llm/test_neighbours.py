import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.llm import neighbours as nn


def plain(rows, every, top=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok.items() if i != q and len(y) == len(x))
            out[q] = d[:top]
    return out


@pytest.mark.parametrize("shard", [4096, 300])
def test_recall_and_exact_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(nn, "SHARD_ROWS", shard)
    monkeypatch.setattr(nn, "BLOCK_BYTES", 1 << 13)
    r = np.random.default_rng(3)
    v = (r.standard_normal((10, 16))[r.integers(0, 10, 1500)] + 0.5 * r.standard_normal((1500, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)]
    rows += [(2000 + i, rows[7][1]) for i in range(200)]  # one common vector
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (None, rows[1][1]), (3300, []), (3400, [None] + rows[0][1][1:]), (3500, [float("inf")] * 16), (3600, [1.0, 2.0]), (3601, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    want, got = plain(rows, 20), {}
    for x in nn.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.score, x.vec_id)
    assert set(got) == set(want)
    hit = total = 0
    for q, near in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == list(range(1, len(near) + 1)) and mine == sorted(mine)
        hit += len({i for _, i in mine} & {i for _, i in near})
        total += len(near)
        exact = dict((i, s) for s, i in near)
        assert all(s == pytest.approx(exact[i], abs=1e-12) for s, i in mine if i in exact)
    assert hit / total >= 0.97


def test_empty_and_single(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nn.nearest(df, F.col("vec_id") % 100 == 0).count() == 0
    assert nn.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
