import sys
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as p
from strandline.llm import packing
from strandline.llm import toxicity as tox
from test_packing import PLAIN

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output, written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, f) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{DATA}/documents.parquet"), *out]


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxic_texts_go(spark, stages):
    bad = {r.doc_id for r in tox.toxicity(stages[0], spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert sorted(texts(stages[1])) == sorted((i, t) for i, t in texts(stages[0]) if i not in bad)


def test_one_of_each_group_stays(stages):
    groups = brute.near_duplicates(texts(stages[1]))
    assert sorted(texts(stages[2])) == sorted((i, t) for i, t in texts(stages[1]) if groups[i][1] == i)


def test_contaminated_texts_go(spark, stages):
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _, hit, _ in brute.contaminated(texts(stages[2]), bench) if hit}
    assert bad and sorted(texts(stages[3])) == sorted((i, t) for i, t in texts(stages[2]) if i not in bad)


def test_every_document_is_mixed_in(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after) and len(before) <= len(after) <= 2 * len(before)


def test_packed_tokens(stages):
    rows = stages[5].collect()
    ids, _ = packing.matrix([r.asDict() for r in rows], packing.LENGTH)
    n = sum(len(PLAIN.encode_ordinary(t or "")) + 1 for _, t in texts(stages[4]))
    assert sum(r.n_tokens for r in rows) == n and ids.shape == (len(rows), packing.LENGTH)


def test_run(spark, stages):
    assert p.run(spark, DATA).count() == stages[5].count()
