"""From raw documents to packed token rows: five stages over the table ``documents``. Empty tables give no rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import decontaminate, mixing, near_dups, packing, toxicity
from strandline.runtime import Scratch

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_REPEATS = 1.25


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier, learnt from the labels of the training folds, scores at its threshold or above go; null and
    empty texts get the score of a text without words, repeated rows are judged alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs, model, DOCUMENT).where(F.col("toxicity_score") < toxicity.CUT).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the text with the smallest doc_id stays. Rows that repeat a doc_id are judged each
    by its own text, rows with equal id and text stay or go together; null and empty texts, and rows without id, stay."""
    gone = near_dups.near_duplicates(docs).where("not kept").select("doc_id", "text_hash").distinct()
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti").select(*DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share a window of words with the benchmark go. Null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at least once, small ones up to MAX_REPEATS times, in the order of epochs and of the blocks within them.
    Null sources are one source; rows without words belong to their source's first epoch."""
    rows = mixing.mix(docs, max_repeats=MAX_REPEATS)[0]
    order = ("epoch", "block_key", "doc_key")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*DOCUMENT)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of all texts; null and empty ones are an end token each, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token packing", pack_tokens),
]

#: Hashing, training and tokenising are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage_{k}")
        if k:
            scratch.drop(f"stage_{k - 1}")
    return docs
