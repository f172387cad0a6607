"""A bitmap of fixed size over row keys: tells, map-side, most rows that a following exact join would drop anyway."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 23


def place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)).cast("long")


def bitmap(rows: DataFrame, *keys: str, at: Column | None = None):
    """A broadcast of BITS bits (1 MB whatever the input; when it fills up, it only passes more rows). ``at``: places other than those of ``keys``."""
    spark, bits = rows.sparkSession, np.zeros(BITS // 32, np.uint32)
    h = rows.select((place(*keys) if at is None else at).alias("h"))
    cells = h.groupBy(F.shiftright("h", 5).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 32))")).alias("v")).toArrow()
    bits[cells["k"].to_numpy()] = cells["v"].to_numpy()
    return spark.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1
