"""Comparison of rows that share a bucket, as a stream over sorted partitions.

A bucket has homes (rows whose own bucket it is) and others (rows that could be near a home). Homes are dealt into
blocks of at most BLOCK; every other row of the bucket meets every block. A task holds one block and one batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: Roles within (key, block): a home of this block, a home of another block, any other row.
HOME, HOME_ELSEWHERE, OTHER = 0, 1, 2


def deal(rows: DataFrame, homes: DataFrame, id_col: str, block: int = BLOCK) -> DataFrame:
    """rows (key, role HOME or OTHER, id_col, ...) with a block, sorted within partitions by key, block and role.
    homes has a `key` for each home row."""
    hot = homes.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") * 2 / block).cast("int").alias("blocks"))
    hot, n = common.lookup(common.materialise(hot, "hot"))
    if n:
        r = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        r = r.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
        r = r.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        r = r.withColumn("role", F.when((F.col("role") == HOME) & (F.col("block") != F.col("own")), HOME_ELSEWHERE).otherwise(F.col("role"))).drop("blocks", "own")
    else:
        r = rows.withColumn("block", F.lit(0))
    return r.repartition("key", "block").sortWithinPartitions("key", "block", "role")


def segments(batches):
    """(key, block) changes: yields (new, key, batch slice) with batch columns key, block, role first."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, block = b.column("key").to_numpy(), b.column("block").to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            now = (int(key[s]), int(block[s]))
            yield now != last, now[0], b.slice(int(s), int(e - s))
            last = now


class Labels:
    """Union of a block's homes."""

    def __init__(self):
        self.lab = np.zeros(0, np.int64)

    def grow(self, n: int) -> None:
        self.lab = np.concatenate([self.lab, np.arange(len(self.lab), len(self.lab) + n)])

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins home x[i] with home y[i] for all i: the larger label hooks onto the smallest it meets, until none is left."""
        while len(x):
            a, b = self.lab[x], self.lab[y]
            far = a != b
            if not far.any():
                return
            x, y, a, b = x[far], y[far], a[far], b[far]
            up = np.arange(len(self.lab))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
            self.lab = up[self.lab]
