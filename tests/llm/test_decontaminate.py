import random

import brute
import pytest
from pyspark.sql import functions as F
from strandline.llm import decontaminate as d


def tables(seed):
    r = random.Random(seed)
    words = ["a", "B", "c9", "d", "é", "f", "g,", "h-i"]
    text = lambda n, top=8: " ".join(words[r.randrange(top)] for _ in range(n))
    bench = [(i, text(r.choice([3, 4, 10, 14, 25]), 5)) for i in range(12)] + [(90, None), (91, "-- "), (92, "A b c9 D é a b c9 d é")]
    bench.append((5, bench[0][1]))
    docs = [(i, text(r.randint(0, 80))) for i in range(40)]
    docs += [(100 + i, f"{text(20)} {b} {text(9)} {b}") for i, (_, b) in enumerate(bench)]
    return docs + [(200, None), (201, ""), (202, "é")] + docs[-3:], bench


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("shard", "slice_"), [(1 << 20, 1 << 21), (50, 1 << 21), (60, 20)])
def test_against_brute_force(spark, monkeypatch, seed, shard, slice_):
    monkeypatch.setattr(d, "SHARD", shard)
    monkeypatch.setattr(d, "SLICE", slice_)
    docs, bench = tables(seed)
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(2)
    found = d.contamination(a, spark.createDataFrame(bench, "item_id long, text string"))
    want = sorted(brute.contaminated(docs, bench))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == want
    assert all(r.n_hit == sum(r.spans[1::2]) - sum(r.spans[::2]) for r in found.collect())
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(found).collect())
    assert got == [(i, n, h, len(x), brute.sha(",".join(x)), h > 0) for i, n, h, x in want]


def test_longest(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "two three four five six seven eight")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "one two three four five six seven eight nine")], "item_id string, text string")
    got = {r.item_word: (r.length, r.doc_id, r.doc_word) for r in d.longest_matches(docs, bench, 5).collect()}
    assert got[0] == (6, 1, 1) and got[1] == (7, 2, 0)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, bench).collect()] == [(2, 0, [])]
