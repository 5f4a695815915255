"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a tiled exact comparison.

Fingerprints are compared tile against tile with numpy exclusive-or and bit counts. Within a task the tiles are
sorted by the population counts of the fingerprint and of its four quarters; a tile pair whose counts differ by more
than the radius can't hold a link and is skipped. Equal fingerprints are one node, so copies cost nothing, and each
task hands on a spanning forest instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, quoted, shares, stored
from .components import smallest_labels, smallest_reachable

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Rows of fingerprints in a file, about.
FILE_ROWS = 1 << 17


def fingerprint(text: str, shingle: int = 4) -> int:
    """The SimHash of a text: a bit is set if over half the shingles' XXH64 have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    of = xxhash.xxh64_intdigest
    h = np.fromiter(
        (of(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        dtype="<u8",
        count=len(words) - k + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. A null text has no words. keyed: and the text's key."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t, shingle) for t in x["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "fp": fp} | ({"key": x["key"]} if keyed else {}))

    rows = id_and_text(docs, id_col, text_col)
    return (rows.withColumn("key", text_key("text")) if keyed else rows).mapInPandas(of, "doc_id long, fp long" + (", key string" if keyed else ""))


def text_key(name: str) -> Column:
    """By this a row's text is known again; a null text counts as an empty one."""
    return F.sha2(F.coalesce(F.col(name), F.lit("")), 256)


def rooted(owner: DataFrame, radius: int) -> DataFrame:
    """owner (fp, first), a row per distinct fp, with the least `first` of each fp's group as `least`; stored.

    Only fps that are linked to another are joined and grouped at all, and a group is reduced before it is shuffled.
    """
    n = owner.count()
    files = shares(n, FILE_ROWS, 8)
    roots = smallest_reachable(links(owner.select("fp"), n, radius), files=files)
    some = stored(owner.join(roots, owner.fp == roots.node).select("fp", "first", "root"), "placed", files)
    least = some.groupBy("root").agg(F.min("first").alias("least"))
    near = some.join(least, "root").select(F.col("fp").alias("near"), "least")
    return stored(owner.join(near, owner.fp == F.col("near"), "left").select("fp", "first", F.coalesce("least", "first").alias("least")), "owners", files)


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = 256, most: int = 1 << 18) -> np.ndarray:
    """Positions in a followed by b: for each, the smallest position it reaches by links between a and b.

    Links that the labels don't know yet are held back, at most `most` and those of one tile pair, and then joined.
    """

    def counted(x: np.ndarray) -> np.ndarray:
        quarters = np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)
        return np.concatenate([quarters.sum(1, keepdims=True), quarters], axis=1)

    def tiled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = counted(x)
        order = np.lexsort(counts[:, [4, 3, 2, 1, 0]].T)
        cut = np.arange(0, len(x), tile)
        return order, np.minimum.reduceat(counts[order], cut, axis=0), np.maximum.reduceat(counts[order], cut, axis=0)

    n = len(a) if same else len(a) + len(b)
    if not len(a) or not len(b):
        return np.arange(n)
    (oa, low_a, high_a), (ob, low_b, high_b) = tiled(a), tiled(b)
    xs, ys = a[oa], b[ob]
    label, found, held = np.arange(n), [], 0

    def joined() -> np.ndarray:
        """The labels after the links found since the last call."""
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        rest = np.flatnonzero(label != np.arange(n))
        return smallest_labels(n, np.concatenate([i, rest]), np.concatenate([j, label[rest]]))

    for s in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[s], low_a[s] - high_b))
        near = np.flatnonzero((gap[:, 0] <= radius) & (gap[:, 1:].sum(1) <= radius))
        x = xs[s * tile : (s + 1) * tile, None]
        for t in near[near >= s] if same else near:
            i, j = np.nonzero(np.bitwise_count(x ^ ys[None, t * tile : (t + 1) * tile]) <= radius)
            if len(i):
                i, j = oa[i + s * tile], ob[j + t * tile] + (0 if same else len(a))
                fresh = label[i] != label[j]
                found.append((i[fresh], j[fresh]))
                held += len(found[-1][0])
                if held > most:
                    label, found, held = joined(), [], 0
    return joined() if found else label


def links(distinct: DataFrame, n: int, radius: int = 4, block: int = 1 << 17, least_blocks: int = 8) -> DataFrame:
    """Forest links (a, b) between the values of distinct's fp, n of them, that differ in at most `radius` bits.

    The values are dealt to blocks by their hash, about `block` in each; every pair of blocks is one task's work. Work is
    quadratic in the number of distinct fingerprints, as the method is; memory is two blocks a task.
    """
    blocks = shares(n, block, least_blocks)

    def packed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        own, body = int(key[0]), np.sort(x["fp"].to_numpy(np.int64)).tobytes()
        return pd.DataFrame({"low": [min(own, k) for k in range(blocks)], "high": [max(own, k) for k in range(blocks)], "own": own, "body": body})

    def compared(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        sides = {int(k): np.frombuffer(v, np.uint64) for k, v in zip(x["own"], x["body"], strict=True)}
        none = np.empty(0, np.uint64)
        same = key[0] == key[1]
        a, b = sides.get(int(key[0]), none), sides.get(int(key[1]), none)
        label = linked(a, b, radius, same)
        every = (a if same else np.concatenate([a, b])).view(np.int64)
        rest = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": every[rest], "b": every[label[rest]]})

    tasks = blocks * (blocks + 1) // 2
    return (
        distinct.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(packed, "low long, high long, own long, body binary")
        .repartition(min(tasks, 4096), "low", "high")
        .groupBy("low", "high")
        .applyInPandas(compared, "a long, b long")
    )


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    fingerprint is 16 lowercase hex digits; component_id the smallest doc_id reachable over links of `radius` bits or
    fewer, itself included. Texts that are null or without words have fingerprint zero and link like any other. Rows
    that repeat a doc_id each get a row. A null doc_id takes part in links but is nobody's component_id: its
    component_id is null unless a row with an id is reachable. An empty table gives an empty result. Texts may be of any
    length: one is worked on whole, in memory of some times its size.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    named = rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), radius).select("fp", F.col("least").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs, with one row of each group of near-duplicates: that of the smallest doc_id.

    Of rows equal in doc_id, the one whose text has the smallest hash stays; of rows equal in text too, any one. A row
    with a null doc_id stays only where no row with an id is near, and then one of its group.
    """
    t = "_ledgerloom_"
    prints = stored(fingerprints(docs, shingle, keyed=True), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    placed = rooted(prints.groupBy("fp").agg(F.min(row).alias("first")), radius)
    chosen = placed.where(F.col("first") == F.col("least")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    # how often a chosen row stands in docs: nearly always once
    times = prints.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    keep = chosen.alias("c").join(times.alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.key") == F.col("t.key")))
    keep = keep.select(F.col("c.doc_id").alias(t + "kept"), F.col("c.key").alias(t + "of"), F.col("n").alias(t + "n"))
    known = docs.withColumns({t + "id": F.col("doc_id").cast("long"), t + "key": text_key("text")})
    # the rows to keep are the side that is held and hashed, so that no text is sorted
    kept = known.join(keep.hint("shuffle_hash"), known[t + "id"].eqNullSafe(keep[t + "kept"]) & (known[t + "key"] == keep[t + "of"]))
    once = Window.partitionBy(t + "id", t + "key").orderBy(t + "key")
    again = kept.where(F.col(t + "n") > 1).withColumn(t + "at", F.row_number().over(once)).where(F.col(t + "at") == 1)
    return kept.where(F.col(t + "n") == 1).select(*names(docs)).unionByName(again.select(*names(docs)))


def names(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]
