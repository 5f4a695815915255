"""Connected components of a graph given by links, in DataFrame operations.

Large-star and small-star rounds alternate: every node first hands its larger neighbours to the smallest node it
knows, then does the same with its smaller ones. Nothing but links between distinct nodes is shuffled, links are
never expanded to all pairs, and each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shares, stored


#: Links that one task writes.
FILE_LINKS = 1 << 20


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    Nulls and self-links are ignored, repeated links count once; without links the result is empty. files: how many
    files the first links are written to; later rounds take one for every FILE_LINKS links.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    pairs, seen = stored(pairs.distinct(), "links", files), None
    while True:
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links", shares(mark[0], FILE_LINKS, 8))
        dropped(last)


def smallest_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links i-j within one task: the smallest node that each reaches."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label
