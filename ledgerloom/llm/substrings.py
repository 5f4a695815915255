"""Substring dedup by fixed-block anchors.

A window of `window` words always holds one whole block of `block` words that starts at a multiple of `block`, as
long as window >= 2 * block - 1. So each document's non-overlapping blocks are indexed, every rolling block-length
window of every document probes that index, and only around the hits are the full windows looked at: hits extend to
all windows that hold them, and overlapping windows make up the maximal exact repeats.

Documents are dealt to chunks by their id. A chunk hands on each of its hashes once, however many of its documents
hold it, so a passage that a third of all documents share is as many rows as there are chunks. Probes travel as 32
bits beside their bucket, which only ever adds candidates; windows are decided by 96 bits.
"""

from __future__ import annotations

import re
import zlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, shares, trim

ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STEP = 0x5851F42D4C957F2D
LAST = 2**63 - 1

SEPARATOR = re.compile(rb"[\x20\x09-\x0d]")
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 1 << 20
#: Words of more bytes are hashed by XXH64, the others eight bytes at a time and all at once.
LONG_WORD = 128
#: Text that a task works on at once, about.
CHUNK_BYTES = 5 << 20
#: Shuffle partitions at most; beyond, a partition holds several chunks, one after the other.
MOST_TASKS = 20_000
#: For every number of bytes: the bits of a little-endian integer that they take.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits; different values stay different."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of body starts, and its hash; body ends with a separator.

    A word's hash starts from its length and takes in eight bytes a round, mixed after each, so that words of one
    length and at most eight bytes never share a hash. Segments of about SEGMENT bytes, cut after a separator, keep
    the arrays small.
    """
    starts, hashes, at = [], [], 0
    while at < len(body):
        cut = SEPARATOR.search(body, min(at + SEGMENT, len(body) - 1))
        end = cut.end() if cut else len(body)
        a = np.frombuffer(body, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(IS_BLANK[a], prepend=True))
        begin, size = edge[::2], edge[1::2] - edge[::2]
        padded = np.concatenate((a, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(a) + 1, "<u8", padded, 0, (1,))  # the eight bytes from every place on
        h = size.astype(np.uint64) * np.uint64(STEP)
        most = int(size.max(initial=0))
        for k in range(0, min(most, LONG_WORD), 8):
            more = slice(None) if k == 0 else np.flatnonzero(size > k)
            h[more] = mixed(h[more] ^ (eight[begin[more] + k] & KEEP[np.minimum(size[more] - k, 8)]))
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            h[k] = xxhash.xxh64_intdigest(body[at + begin[k] : at + begin[k] + size[k]], 13)
        starts.append(begin + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class Chunk:
    """The words of some documents as hashes, one document after the other."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        begin, self.words = word_hashes(b"".join(x for r in raw for x in (r, b"\n")))
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(begin, ends)
        self.sizes = np.diff(upto, prepend=0)
        self.starts = upto - self.sizes
        self.doc = np.repeat(np.arange(len(raw), dtype=np.int32), self.sizes)
        self.left = (np.repeat(upto, self.sizes) - np.arange(len(self.words))).astype(np.int32)  # words up to the document's end

    def rolling(self, k: int, seed: int) -> np.ndarray:
        """The hash of the k words from each position on; only valid where fits(k) says so."""
        base = np.uint64((2 * seed + 1) * STEP & (2**64 - 1))
        out = np.zeros(len(self.words), np.uint64)
        n = len(self.words) - k + 1
        if n > 0:
            for i in range(k):
                out[:n] *= base
                out[:n] += self.words[i : i + n]
        return mixed(out)

    def fits(self, k: int) -> np.ndarray:
        return self.left >= k

    def aligned(self, k: int) -> np.ndarray:
        place = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)
        return place % k == 0


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted array `of`; a table of bits spares most of x the search."""
    out = np.zeros(len(x), bool)
    if not len(of) or not len(x):
        return out
    bits = min(24, max(8, (16 * len(of)).bit_length()))
    slot = lambda v: (v.astype(np.uint64) * ODD) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[slot(of)] = True
    maybe = np.flatnonzero(table[slot(x)])
    v = x[maybe]
    out[maybe] = of[np.minimum(np.searchsorted(of, v), len(of) - 1)] == v
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of x, sorted; sorting is several times as fast as np.unique, which hashes."""
    s = np.sort(x)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def squeezed(x: np.ndarray) -> bytes:
    """Rising 32-bit values as compressed bytes: differences, byte plane by byte plane."""
    return zlib.compress(np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueezed(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def twice(x: np.ndarray) -> np.ndarray:
    """The values that x holds more than once, sorted."""
    s = np.sort(x)
    return distinct(s[1:][s[1:] == s[:-1]])


def cut(docs: DataFrame, window: int, block: int, chunk_bytes: int, id_col: str, text_col: str, carried: list[str], join_all: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, text, and the carried columns of docs as c0, c1, ...), a row per row of docs.

    A word goes if a window of `window` words that covers it starts in a document with a smaller doc_id too. text: the
    words that stay, joined by single spaces, of every row; else of those that lose a word, and the others' as it is. A
    null text has no words. Rows that repeat a doc_id are judged each against smaller ids only, so equal rows stay; a
    null doc_id counts as the largest and never takes words from others. Empty tables give empty results. Texts may be
    of any length; one longer than chunk_bytes is worked on whole. Carried columns travel in Arrow's types.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    others = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(carried)]
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *others)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0]
    chunks = shares(total, chunk_bytes)
    # a null or repeated id must not gather its rows in one chunk
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(min(chunks, MOST_TASKS), "chunk")
    buckets = chunks

    def texts(x: pa.Table) -> list[str]:
        return ["" if t is None else t for t in x["text"].to_pylist()]

    def ids(x: pa.Table) -> np.ndarray:
        return x["doc_id"].fill_null(LAST).to_numpy()

    def split(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of a block's hash, and the 32 bits that stand for it there; both rise with the hash."""
        scaled = (h >> np.uint64(20)) * np.uint64(buckets)
        return (scaled >> np.uint64(44)).astype(np.int64), (scaled >> np.uint64(12)).astype(np.uint32)

    def probes(key: tuple, x: pa.Table) -> pa.Table:
        """Per bucket: the chunk's distinct rolling blocks, and of those the ones that stand at an indexed place."""
        c = Chunk(texts(x))
        h, ok = c.rolling(block, 1), c.fits(block)
        rolling, index = distinct(h[ok]), distinct(h[ok & c.aligned(block)])
        to, short = split(rolling)
        indexed = member(rolling, index)
        at = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(at[1:], len(to))
        return pa.table(
            {
                "bucket": to[at],
                "chunk": pa.array([key[0].as_py()] * len(at), pa.int64()),
                "probes": pa.array([squeezed(short[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
                "index": pa.array([squeezed(short[a:b][indexed[a:b]]) for a, b in zip(at, ends, strict=True)], pa.binary()),
            }
        )

    def hits(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        """Per chunk: those of its blocks that are indexed anywhere and stand in another chunk too."""
        sets = [unsqueezed(v) for v in x["probes"]]
        shared = twice(np.concatenate(sets))
        index = distinct(np.concatenate([unsqueezed(v) for v in x["index"]]))
        shared = shared[member(shared, index)]
        own = [s[member(s, shared)] for s in sets]
        keep = [k for k, s in enumerate(own) if len(s)]
        return pd.DataFrame({"chunk": x["chunk"].iloc[keep].to_numpy(np.int64), "bucket": int(key[0]), "hits": [squeezed(own[k]) for k in keep]})

    def candidates(c: Chunk, y: pa.Table) -> np.ndarray:
        """Where a full window starts that holds a block found in another document."""
        h, ok = c.rolling(block, 1), c.fits(block)
        to, short = split(h)
        code = to.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64)
        known = [unsqueezed(v).astype(np.uint64) | np.uint64(int(k)) << np.uint64(32) for k, v in zip(y["bucket"].to_pylist(), y["hits"].to_pylist(), strict=True)]
        hit = ok & (member(h, twice(h[ok])) | member(code, np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)))
        ahead = np.concatenate(([0], np.cumsum(hit)))
        at = np.flatnonzero(c.fits(window))
        return at[ahead[at + window - block + 1] > ahead[at]]

    def keyed(c: Chunk, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), [("h", "<u8"), ("g", "<u4")])
        out["h"], out["g"] = c.rolling(window, 2)[at], c.rolling(window, 3)[at] >> np.uint64(32)
        return out

    def smallest(k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order and the smallest d of each."""
        order = np.lexsort((d, k["g"], k["h"]))
        k, d = k[order], d[order]
        first = np.ones(len(k), bool)
        first[1:] = (k["h"][1:] != k["h"][:-1]) | (k["g"][1:] != k["g"][:-1])
        return k[first], d[first]

    def windows(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        """Per bucket: the chunk's candidate windows and the smallest document that holds each."""
        c = Chunk(texts(x))
        at = candidates(c, y)
        k, d = smallest(keyed(c, at), ids(x)[c.doc[at]])
        to = (k["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        k, d, to = k[order], d[order], to[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        parts = list(zip(first, np.append(first[1:], len(to)), strict=True))
        return pa.table(
            {
                "bucket": to[first],
                "chunk": pa.array([key[0].as_py()] * len(first), pa.int64()),
                "keys": pa.array([k[a:b].tobytes() for a, b in parts], pa.binary()),
                "docs": pa.array([d[a:b].tobytes() for a, b in parts], pa.binary()),
            }
        )

    def owners(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        """Per chunk: its windows that a smaller document of another chunk holds, with that document."""
        kind = [("h", "<u8"), ("g", "<u4")]
        keys = [np.frombuffer(v, kind) for v in x["keys"]]
        docs_ = [np.frombuffer(v, np.int64) for v in x["docs"]]
        k, d = smallest(np.concatenate(keys), np.concatenate(docs_))
        out = {"chunk": [], "keys": [], "docs": []}
        for chunk, own, least in zip(x["chunk"], keys, docs_, strict=True):
            best = np.empty(len(own), np.int64)
            # own is a sorted part of k; equal 64-bit halves are told apart by the other 32 bits
            at = np.searchsorted(k["h"], own["h"])
            while True:
                wrong = k["g"][at] != own["g"]
                if not wrong.any():
                    break
                at = at + wrong
            best[:] = d[at]
            less = best < least
            if less.any():
                out["chunk"].append(int(chunk))
                out["keys"].append(own[less].tobytes())
                out["docs"].append(best[less].tobytes())
        return pd.DataFrame(out)

    def judged(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        whole = texts(x)
        c, own = Chunk(whole), ids(x)
        kind = [("h", "<u8"), ("g", "<u4")]
        far = np.concatenate([np.empty(0, kind), *(np.frombuffer(v, kind) for v in y["keys"].to_pylist())])
        far_doc = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(v, np.int64) for v in y["docs"].to_pylist())])
        # a window that another document holds is twice in the chunk, or among the owners' keys
        h, fits = c.rolling(window, 2), c.fits(window)
        at = np.flatnonzero(fits & (member(h, twice(h[fits])) | member(h, np.sort(far["h"]))))
        k = keyed(c, at)
        mine = own[c.doc[at]]
        every, least = np.concatenate([k, far]), np.concatenate([mine, far_doc])
        order = np.lexsort((least, every["g"], every["h"]))
        e = every[order]
        first = np.ones(len(e), bool)
        first[1:] = (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])
        group = np.cumsum(first) - 1
        best = np.empty(len(e), np.int64)
        best[order] = least[order][np.flatnonzero(first)][group] if len(e) else 0
        taken = at[best[: len(at)] < mine]
        cover = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(cover, taken, 1)
        np.add.at(cover, taken + window, -1)
        drop = np.cumsum(cover)[:-1] > 0
        gone = np.concatenate(([0], np.cumsum(drop)))
        gone = gone[c.starts + c.sizes] - gone[c.starts]
        kept = x["text"].to_pylist()
        for k in range(len(kept)) if join_all else np.flatnonzero(gone).tolist():
            kept[k] = left_over(whole[k], drop[c.starts[k] : c.starts[k] + c.sizes[k]] if gone[k] else None)
        trim()
        own = {"doc_id": x["doc_id"], "n_words": c.sizes.astype(np.int64), "n_removed": gone.astype(np.int64), "text": pa.array(kept, pa.string())}
        return pa.table(own | {f"c{k}": x[f"c{k}"] for k in range(len(carried))})

    made = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "n_removed")] + [T.StructField("text", T.StringType())] + [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carried)])
    first = dealt.groupBy("chunk").applyInArrow(probes, "bucket long, chunk long, probes binary, index binary")
    found = first.groupBy("bucket").applyInPandas(hits, "chunk long, bucket long, hits binary")
    second = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(windows, "bucket long, chunk long, keys binary, docs binary")
    owned = second.groupBy("bucket").applyInPandas(owners, "chunk long, keys binary, docs binary")
    return dealt.groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInArrow(judged, made)


def left_over(text: str, drop: np.ndarray | None) -> str:
    """The words that stay, joined by single spaces."""
    # bytes.split() splits at exactly the six separators
    words = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(words if drop is None else compress(words, (~drop).tolist())).decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, window: int = 13, block: int = 7, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): the text's remaining words joined by single spaces; see cut."""
    return cut(docs, window, block, chunk_bytes, id_col, text_col, [], True)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of what deduplicated() returns."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 13, block: int = 7, chunk_bytes: int = CHUNK_BYTES, n_chars: str = "n_chars") -> DataFrame:
    """docs (doc_id, text and any other columns) with the repeated words taken out of the text.

    A text that loses no word stays as it is, blanks included; a text that loses some is its other words joined by
    single spaces, and n_chars, where there is such a column, its new length. A document that loses all its words goes.
    """
    others = [c for c in docs.columns if c != "text"]
    done = cut(docs, window, block, chunk_bytes, "doc_id", "text", others, False)
    done = done.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    of = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if n_chars in others:
        of[n_chars] = F.when(F.col("n_removed") == 0, of[n_chars]).otherwise(F.length("text")).cast(docs.schema[n_chars].dataType)
    return done.select(*[of[c].alias(c) for c in docs.columns])
