"""Mixing sources by temperature.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is found by bisection, so that
the weights have a target entropy, or so that no source is repeated more than a limit allows. Weights times the budget
are realised source by source: whole epochs of it first, then a part of one more. In every epoch the source's blocks come
in an order of their own (a seeded hash of epoch and block), and so do the documents of a block; the part is cut where
the budget is met, first to the block, then to the document within that block.

Only sums by source and block are shuffled, pre-aggregated; which rows an epoch takes is then a comparison of hashes, so
no source, however large, is ever gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Scratch

BLOCK_TOKENS, MAX_BLOCKS = 1 << 16, 4096
TOKENS = r"[^ \t\n\x0B\f\r]+"
ADDED = ("mix_source", "mix_tokens", "mix_block", "mix_part", "mix_doc")


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: float
    weights: dict[str, float]
    repeats: dict[str, float]


def weights_at(shares: dict[str, float], exponent: float) -> dict[str, float]:
    top = max(shares.values())
    raw = {s: (p / top) ** exponent for s, p in shares.items()}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in weights.values() if x > 0)


def bisect(good, low: float, high: float) -> float:
    """The smallest exponent of [low, high] from which ``good`` holds; high if it never does."""
    if good(low):
        return low
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def plan(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> Plan:
    """Weights of the sources that have tokens. Without a budget, it is such that each source is taken at least once.

    With ``target_entropy`` (in nats) the exponent is where the weights' entropy falls to it; with ``max_repeats`` it is the
    smallest, from 0, at which no source is repeated more often; with neither it is 1. If even exponent 1 repeats a source
    too often (the budget is more than max_repeats times all tokens), the budget is lowered to what the limit allows.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Plan(1.0, 0.0, {}, {})
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def size(weights):
        return budget if budget is not None else max(n / weights[s] for s, n in tokens.items())

    def repeats(weights):
        b = size(weights)
        return {s: weights[s] * b / n for s, n in tokens.items()}

    if target_entropy is not None:
        exponent = bisect(lambda x: entropy(weights_at(shares, x)) <= target_entropy, 0.0, 64.0)
    elif max_repeats is not None:
        exponent = bisect(lambda x: max(repeats(weights_at(shares, x)).values()) <= max_repeats, 0.0, 1.0)
    else:
        exponent = 1.0
    weights = weights_at(shares, exponent)
    b, r = size(weights), repeats(weights)
    if max_repeats is not None and max(r.values()) > max_repeats * (1 + 1e-9):
        b *= max_repeats / max(r.values())
        r = {s: weights[s] * b / n for s, n in tokens.items()}
    # nearly whole epochs are whole
    return Plan(exponent, b, weights, {s: round(x) if abs(x - round(x)) < 1e-9 else x for s, x in r.items()})


def _order(seed: int, epoch: Column, *of: str) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), *of)


def mix(docs: DataFrame, seed: int = 17, **target) -> tuple[DataFrame, Plan]:
    """(rows of ``docs`` as scheduled, plan). Rows have all columns of ``docs`` (doc_id, text and source among them) and
    n_tokens, epoch, block_key and doc_key: the training order is by epoch, block_key, doc_key.

    Null sources are one source of their own. Rows without words belong to their source's first epoch, or not to a
    mixture at all if the source has no tokens. Repeated rows share their place. An empty table gives no rows. Columns of
    ``docs`` with the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block_key", "doc_key", *ADDED)]
    docs = docs.select(*names).withColumn("mix_source", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    docs = docs.withColumn("mix_tokens", F.coalesce(F.regexp_count("text", F.lit(TOKENS)), F.lit(0)).cast("long")).withColumn("mix_doc", F.xxhash64("doc_id", "text"))
    scratch = Scratch(spark)
    sizes = scratch.save(docs.select("mix_source", "mix_tokens", "mix_doc"), "sizes")
    tokens = {r[0]: r[1] for r in sizes.groupBy("mix_source").agg(F.sum("mix_tokens")).collect()}
    p = plan(tokens, **target)
    rows = [(s, max(1, min(MAX_BLOCKS, -(-tokens[s] // BLOCK_TOKENS))), int(r), float((r - int(r)) * tokens[s])) for s, r in p.repeats.items()]
    per = spark.createDataFrame(rows, "mix_source string, blocks int, whole int, rest double")
    block = F.pmod("mix_doc", "blocks").cast("int").alias("mix_block")

    # where the part of an epoch ends: the block, then the document
    sizes = sizes.join(F.broadcast(per), "mix_source").where("rest > 0").select("*", block)
    by = Window.partitionBy("mix_source").orderBy("key", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("mix_source", "mix_block", "whole", "rest").agg(F.sum("mix_tokens").alias("n")).withColumn("key", _order(seed, F.col("whole"), "mix_source", "mix_block"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    last = blocks.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select("mix_source", "mix_block", "key", (F.col("rest") - F.col("before")).alias("left"))
    inside = sizes.join(F.broadcast(last), ["mix_source", "mix_block"]).withColumn("doc_key", _order(seed, F.col("whole"), "mix_doc"))
    by = Window.partitionBy("mix_source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("mix_tokens").over(by), F.lit(0))).where("before < left")
    cut = inside.groupBy("mix_source", "key", "mix_block").agg(F.max("doc_key").alias("doc_cut")).collect()
    cuts = {r.mix_source: r for r in cut}
    full = [(s, b, k, r, *((cuts[s].key, cuts[s].mix_block, cuts[s].doc_cut) if s in cuts else (None, None, None))) for s, b, k, r in rows]
    per = spark.createDataFrame(full, "mix_source string, blocks int, whole int, rest double, cut_key long, cut_block int, cut_doc long")
    per = F.broadcast(per) if len(full) <= 100_000 else per

    out = docs.join(per, "mix_source").withColumn("mix_block", F.pmod("mix_doc", "blocks").cast("int"))
    key = _order(seed, F.col("whole"), "mix_source", "mix_block")
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("mix_block") < F.col("cut_block")))
    part = F.when(F.col("rest") > 0, before | ((F.col("mix_block") == F.col("cut_block")) & (_order(seed, F.col("whole"), "mix_doc") <= F.col("cut_doc")))).otherwise(False)
    part = F.coalesce(part, F.lit(False)) & ((F.col("mix_tokens") > 0) | (F.col("whole") == 0))
    epochs = F.when(F.col("mix_tokens") > 0, F.col("whole")).otherwise(F.least("whole", F.lit(1))) + part.cast("int")
    out = out.withColumn("mix_part", epochs).where("mix_part > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("mix_part") - 1)))
    return out.select(*names, F.col("mix_tokens").alias("n_tokens"), "epoch", _order(seed, F.col("epoch"), "mix_source", "mix_block").alias("block_key"), _order(seed, F.col("epoch"), "mix_doc").alias("doc_key")), p
