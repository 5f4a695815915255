"""Tokenizing whole documents, the binary token format, and packing into windows.

The format (operator 8): ids are ranked by their frequency over all documents, so that most take one byte. A value of
1 to 4 bytes is stored little-endian; its length less one goes to a separate stream of control bytes, two bits a
value, four values a byte. Reading looks every control byte up in a table of 256 rows of lengths and offsets.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import threading
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, made, shared_folder, shares, stored, trim

#: Parts that can be encoded one by one. All tokenizers here cut between a character that is not blank and a blank,
#: and between a letter or digit and ASCII punctuation; apostrophes and what is not listed stay with their neighbours.
#: Texts with other blanks than these six, or with added tokens of the tokenizer, are encoded whole.
_BLANK, _MARK, _LETTER = r" \t\n\r\f\v", re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), "A-Za-z0-9À-ÖØ-öø-ÿ"
_BODY = f"(?:[{_LETTER}]++(?=[{_MARK}{_BLANK}]|\\Z)|[{_MARK}]++(?=[{_LETTER}{_BLANK}]|\\Z)|[^{_BLANK}]+)"
PART, BARE_PART = re.compile(f"[{_BLANK}]*{_BODY}|[{_BLANK}]+"), re.compile(_BODY)
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Without these bytes in its UTF-8 a text has none of them.
_SIGNS = b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef"
#: What ASCII and letters from À to ÿ are made of: texts without other blanks, combining marks or other capitals.
_LATIN = bytes(b for b in range(192) if not 28 <= b <= 31) + b"\xc3"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
KNOWN_PARTS, IDLE_S = 1_200_000, 8
#: Shuffle partitions at most; beyond, a task makes several files or shards, one after the other.
MOST_TASKS = 20_000
#: A to Z, a to z, and the letters from À to ÿ.
LETTERS = [chr(c) for c in range(65, 256) if chr(c).isalpha() and c not in (170, 181, 186)]
BARE_WORD, WORD = re.compile(f"[{''.join(LETTERS)}]+").fullmatch, re.compile(f" ?[{''.join(LETTERS)}]+").fullmatch


class Encoder:
    """The tokenizers library with a memory of the parts seen; the memory is bounded and only saves time.

    Spark keeps its workers, so one that has encoded nothing for IDLE_S seconds gives the memory back.
    """

    def __init__(self, path: str, width: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # such tokens are looked for in the normalized text, which is not at hand here: every text is encoded whole
        self.loose = self.tokenizer.normalizer is not None and any(t.normalized for t in added)
        self.code, self.known = {"<u2": "H", "<u4": "I"}[width], {}
        self.lock, self.timer = threading.Lock(), None
        # where blanks give no ids, parts are kept without them
        # where A-Z count as a-z, parts are kept in lower case, unless that could make an added token that is always matched
        self.fold = all(t.special for t in added) and self.plain(["AbZ É"]) == self.plain(["abz é"])
        self.parts = BARE_PART if self.plain([" a", "\n"]) == [*self.plain(["a"]), b""] else PART
        self.table = self.spelled()

    def plain(self, texts: list[str], whole: bool = False) -> list[bytes]:
        """The library's ids of whole texts; or of parts, which hold no added token but can look like one when folded."""
        self.tokenizer.encode_special_tokens = not whole
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spelled(self) -> dict[int, str] | None:
        """How the library's model gets each letter, and a blank before letters; None where words of letters are not one
        unit to it, or not spelled letter by letter."""
        t = self.tokenizer
        if t.pre_tokenizer is None or t.model is None:
            return None
        units = lambda w: [u for u, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(w) if t.normalizer else w)]
        table = {ord(c): (units(c) or [""])[0] for c in LETTERS}
        blank = units(" a")
        if len(blank) == 1:
            table[32] = blank[0].removesuffix(table[ord("a")])
        for c in LETTERS:
            for w in (f"x{c}y", f"{c}X", f"É{c}", *([f" {c}z"] if 32 in table else [])):
                if units(w) != [w.translate(table)]:
                    return None
        return table

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts. Words of letters go to the model alone, without the steps before and after it, which find nothing to do."""
        if not self.table:
            return self.plain(parts)
        model, table, code = self.tokenizer.model.tokenize, self.table, self.code
        alone = WORD if 32 in table else BARE_WORD
        out = [array(code, [x.id for x in model(w.translate(table))]).tobytes() if alone(w) else None for w in parts]
        rest = [k for k, v in enumerate(out) if v is None]
        for k, v in zip(rest, self.plain([parts[k] for k in rest]) if rest else [], strict=True):
            out[k] = v
        return out

    def cut(self, text: str) -> list[str] | None:
        """The parts of a text; None where it is to be encoded whole."""
        if self.loose or any(a in text for a in self.added):
            return None
        raw = text.encode("utf-8", "surrogatepass")
        if not raw.translate(None, _LATIN):
            return self.parts.findall(raw.translate(_LOWER).decode() if self.fold else text)
        if len(raw.translate(None, _SIGNS)) != len(raw) and OTHER_BLANKS.search(text):
            return None
        return self.parts.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the given width."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            out = self.encode_parts(texts)
            self.timer = threading.Timer(IDLE_S, self.forget)
            self.timer.daemon = True
            self.timer.start()
        return out

    def forget(self) -> None:
        with self.lock:
            self.known.clear()
            gc.collect()
            trim()

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            known, some = self.known, texts[at : at + 256]
            parts = [self.cut(t) for t in some]
            ids = [None if ps is None else list(map(known.get, ps)) for ps in parts]
            gaps = [[] if x is None else list(compress(range(len(x)), map(is_, x, repeat(None)))) for x in ids]
            fresh = list({ps[k] for ps, gap in zip(parts, gaps, strict=True) for k in gap})
            new = dict(zip(fresh, self.of_parts(fresh), strict=True))
            for t, ps, x, gap in zip(some, parts, ids, gaps, strict=True):
                for k in gap:
                    x[k] = new[ps[k]]
                out.append(self.plain([t], True)[0] if x is None else b"".join(x))
            if len(known) + len(new) > KNOWN_PARTS:
                known.clear()
            known.update(new)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, width: str) -> Encoder:
    """One a worker process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, ids): ids as little-endian 16-bit integers, the end id last; and (id, n), how often each id stands in
    the rows of one task, many rows an id. Both are of one table in the shared folder, whose last row of a task has the counts.

    A null or empty text is the end id alone. path must hold a vocabulary of at most 65,536 ids. Texts may be of any length
    and are encoded whole.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = struct.pack("<H", end_id)
        coder, total = encoder(path, "<u2"), np.zeros(1 << 16, np.int64)
        for x in batches:
            ids = [b + end for b in coder.encode(x["text"].tolist())]
            for at in range(0, len(ids), 64):
                total += np.bincount(np.frombuffer(b"".join(ids[at : at + 64]), "<u2"), minlength=1 << 16)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "n": [len(b) // 2 for b in ids], "ids": ids, "id": None, "times": None})
        if len(seen := np.flatnonzero(total)):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": -1, "ids": [None], "id": [seen], "times": [total[seen]]})

    table = stored(id_and_text(docs, id_col, text_col).mapInPandas(of, "doc_id long, n long, ids binary, id array<long>, times array<long>"), "tokens")
    return table.where("n >= 0").select("doc_id", "n", "ids"), table.where("n < 0").select(F.inline(F.arrays_zip("id", F.col("times").alias("n"))))


# ---------------------------------------------------------------- the binary format

#: For every control byte: the lengths of its four values.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


#: Values coded at a time, so that what is worked on stays in the processor's cache; a multiple of 4.
_STRIDE = 1 << 15


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    control, data = [], []
    for at in range(0, len(values), _STRIDE):
        v = values[at : at + _STRIDE].astype("<u4")
        longest = max(1, -(-int(v.max()).bit_length() // 8))
        more = np.zeros(-(-len(v) // 4) * 4, np.uint8)
        for k in range(1, longest):
            more[: len(v)] += v >= np.uint32(1 << (8 * k))
        control.append((more.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
        data.append(v.view(np.uint8).reshape(-1, 4)[:, :longest][np.arange(longest, dtype=np.uint8) <= more[: len(v), None]].tobytes())
    return b"".join(control), b"".join(data)


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack_values stored."""
    signs, body, out, done = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.empty(n, np.uint32), 0
    for at in range(0, n, _STRIDE):
        size = _LENGTHS[signs[at // 4 : (at + _STRIDE) // 4]].ravel()[: min(_STRIDE, n - at)]
        ends = np.cumsum(size, dtype=np.int64)
        start = ends - size + done
        part = body[start].astype(np.uint32)
        for k in range(1, int(size.max())):
            has = np.flatnonzero(size > k)
            part[has] |= body[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
        out[at : at + _STRIDE] = part
        done += int(ends[-1])
    return out


MAGIC = b"LLTK1\n"


def write_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> bytes:
    """One file: magic, five counts, then null flags, doc_ids, sizes, control bytes and data bytes."""
    control, data = pack_values(rank[ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = struct.pack("<QQQQ", len(doc_ids), len(ids), len(control), len(data))
    return b"".join([MAGIC, head, null.tobytes(), own.tobytes(), sizes.astype("<i8").tobytes(), control, data])


def read_file(body: bytes, id_of: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids (None for null), sizes and ids of a file; id_of has the id of each rank."""
    if body[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    docs, n, c, d = struct.unpack_from("<QQQQ", body, at := len(MAGIC))
    at += 32
    null = np.frombuffer(body, np.uint8, docs, at)
    own = np.frombuffer(body, "<i8", docs, at + docs)
    sizes = np.frombuffer(body, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    ids = id_of[unpack_values(body[at : at + c], body[at + c : at + c + d], n)]
    return [None if z else int(x) for z, x in zip(null, own, strict=True)], sizes, ids


def written(docs: DataFrame, path: str, end_id: int, file_tokens: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[int]]:
    """Write docs' ids in ascending doc_id order; the folder of files, and the ids in order of frequency.

    Ids that never occur come last; ties go to the smaller id. Each file is a range of doc_ids of about file_tokens, or of
    rows of one doc_id where that has more. Null ids come first; rows that repeat an id are in order of their ids' hash;
    a null text is the end id alone; an empty table gives no files.
    """
    table, counted = token_table(docs, path, end_id, id_col, text_col)
    spark = docs.sparkSession
    # at most 65,536 rows, whatever the input
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    total = sum(r["n"] for r in counts)
    files = shares(total, file_tokens)
    rank = np.zeros(1 << 16, np.uint32)
    rank[np.array(order, np.int64)] = np.arange(len(order))

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sizes, ids, held = [], [], [], 0
        file = lambda: pd.DataFrame({"body": [write_file(own, np.concatenate(sizes), np.concatenate(ids), rank)]})
        for x in batches:
            for at in range(0, len(x), 256):
                part = x.iloc[at : at + 256]
                own += [None if pd.isna(d) else int(d) for d in part["doc_id"].astype("Int64")]
                sizes.append(part["n"].to_numpy(np.int64))
                ids.append(np.frombuffer(b"".join(part["ids"]), "<u2"))
                held += len(ids[-1])
                if 2 * held > 3 * file_tokens:
                    yield file()
                    own, sizes, ids, held = [], [], [], 0
        if own:
            yield file()

    folder = made(f"{shared_folder(spark)}/ledgerloom-files-{os.urandom(8).hex()}")
    ordered = table.repartitionByRange(min(files, MOST_TASKS), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    # The text writer stores the bytes of a string as they are and ends the row with one byte, which read_file ignores. A
    # file is one row; the names of a task's files go on in order.
    ordered.mapInPandas(filed, "body binary").select(F.col("body").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder, lineSep="\0")
    return folder, order


def read_back(spark, folder: str, order: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone; start counts the ids of all documents before.

    One row per document written, null ids included; a folder without files gives no rows.
    """
    id_of = np.array([*order, 0], np.uint32)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, body in zip(x["path"], x["content"], strict=True):
                own, sizes, ids = read_file(body, id_of)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pd.DataFrame({"path": file, "doc_id": pd.array(own, "Int64"), "within": ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    rows = stored(files.mapInPandas(of, "path string, doc_id long, within long, n_tokens long, ids_crc32 long"), "read")
    # a row a file: the files' names are in the order of their ranges
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("path").agg(F.sum("n_tokens").alias("n")).select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, "path").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


# ---------------------------------------------------------------- packing


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing lengths, at most `depth` of them, that fill `units` exactly."""

    def more(left: int, largest: int, deep: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif deep and left <= largest * deep:
            for k in range(min(left, largest), 0, -1):
                for rest in more(left - k, k, deep - 1):
                    yield (k, *rest)

    return list(more(units, units, depth))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by growing and shrinking the set of columns in use."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    slack = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * n):
        pull = np.where(used, -np.inf, right - gram @ x)
        if pull.max(initial=-np.inf) <= slack:
            break
        used[int(pull.argmax())] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            used[at[(x[at] <= 1e-12) | (low & (x[at] <= 1e-12))]] = False
            x[~used] = 0
    return x


def plan(histogram: dict[int, int], length: int, unit: int, depth: int) -> list[tuple[tuple[int, ...], float]]:
    """Combinations of length classes, and how often each is to be used: solved against the histogram of rests.

    A class holds the lengths that round up to the same multiple of `unit`. Missing a long rest costs more than a
    short one, so classes are weighted by their length.
    """
    units = length // unit
    have = np.zeros(units + 1)
    for n, k in histogram.items():
        have[-(-n // unit)] += k
    ways = combinations(units, depth)
    a = np.zeros((units, len(ways)))
    for j, way in enumerate(ways):
        for k in way:
            a[k - 1, j] += 1
    weight = np.sqrt(np.arange(1, units + 1))
    x = non_negative_least_squares(a * weight[:, None], have[1:] * weight)
    return [(ways[j], float(x[j])) for j in np.flatnonzero(x)]


def pack_shard(sizes: list[int], ways: list[tuple[tuple[int, ...], float]], share: float, length: int, unit: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given sizes.

    A document fills whole windows first. The rests are placed by the plan, each combination as often as the shard's
    share of it says, rounded down. Rests that are left fill what the windows still lack, cut where a window is full,
    and then windows of their own; only the shard's last window can be short.
    """
    pieces, bins, waiting = [], [], {}
    seq = 0
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            pieces.append((d, start, length, seq, 0))
            seq += 1
        if n % length:
            waiting.setdefault(-(-(n % length) // unit), []).append(d)
    for way, times in sorted(ways, key=lambda w: (-w[1], w[0])):
        for _ in range(int(times * share + 1e-9)):
            need: dict[int, int] = {}
            for k in way:
                need[k] = need.get(k, 0) + 1
            if any(len(waiting.get(k, ())) < n for k, n in need.items()):
                break
            bins.append([waiting[k].pop() for k in way])
    left = [(d, sizes[d] - sizes[d] % length, sizes[d] % length) for k in sorted(waiting, reverse=True) for d in waiting[k]]
    at = 0
    for own in bins:
        offset = 0
        for d in own:
            n = sizes[d] % length
            pieces.append((d, sizes[d] - n, n, seq, offset))
            offset += n
        while offset < length and at < len(left):
            d, start, n = left[at]
            take = min(n, length - offset)
            pieces.append((d, start, take, seq, offset))
            offset += take
            left[at] = (d, start + take, n - take)
            at += n == take
        seq += 1
    offset = 0
    while at < len(left):
        d, start, n = left[at]
        take = min(n, length - offset)
        pieces.append((d, start, take, seq, offset))
        offset += take
        left[at] = (d, start + take, n - take)
        at += n == take
        if offset == length:
            seq, offset = seq + 1, 0
    return pieces


def packed(docs: DataFrame, path: str, end_id: int, length: int = 2048, unit: int = 32, depth: int = 3, shard_tokens: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    The histogram of rests over all documents (at most `length` rows) is solved once; shards of about shard_tokens
    then place their own documents by it, so no task sees more than a shard. Null and empty texts are the end id
    alone. Rows that repeat a doc_id are packed each. An empty table gives no pieces.
    """
    if length % unit:
        raise ValueError("unit must divide length")
    table, _ = token_table(docs, path, end_id, id_col, text_col)
    rows = table.groupBy((F.col("n") % length).alias("rest")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).collect()
    ways = plan({r["rest"]: r["docs"] for r in rows if r["rest"]}, length, unit, depth)
    shards = shares(sum(r["tokens"] for r in rows), shard_tokens)
    every = sum(r["docs"] for r in rows if r["rest"])

    def of(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        sizes = x["n"].tolist()
        share = sum(1 for n in sizes if n % length) / max(1, every)
        raw = [np.frombuffer(b, "<u2").astype("<u4").tobytes() for b in x["ids"]]
        p = pack_shard(sizes, ways, share, length, unit)
        d = [r[0] for r in p]
        return pd.DataFrame(
            {
                "doc_id": x["doc_id"].astype("Int64").iloc[d].to_numpy(object, na_value=None),
                "start": [r[1] for r in p],
                "length": [r[2] for r in p],
                "ids_crc32": [zlib.crc32(raw[r[0]][4 * r[1] : 4 * (r[1] + r[2])]) for r in p],
                "doc_tokens": [sizes[k] for k in d],
                "shard": int(key[0]),
                "own": [r[3] for r in p],
                "offset": [r[4] for r in p],
            }
        )

    # by rows, not by ids, so that neither null nor repeated ones gather; the table is written, so a row keeps its number
    salt = F.xxhash64(F.monotonically_increasing_id())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long, own long, offset long"
    pieces = stored(table.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("long")).repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(of, schema), "pieces")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.groupBy("shard").agg((F.max("own") + 1).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return pieces.join(first, "shard").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("own")).alias("sequence_id"), "offset")
