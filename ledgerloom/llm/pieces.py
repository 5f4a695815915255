"""SentencePiece encoding and decoding in batches of numpy operations.

Texts are cut into words, distinct words of equal length are rows of one matrix, and all of them advance together
through Viterbi. A substring is known by a hash made from prefix sums, and hashes probe the sorted hashes of the pieces.
At each end position, maxima over all piece lengths at once store backpointers. Unigram models maximise the sum of
scores. For a BPE model the highest sum is not the result; but of the pieces that end somewhere, exactly one can follow
the last piece of the text before it such that merging would not have joined across the two. So such models maximise
whether a piece may follow, a question that is answered by undoing merges of the two pieces, the latest first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

SPACE = "▁"
#: Pieces hold the space mark only at their start, so a text can be cut before every run of marks. Where no piece has
#: a letter or digit before one of CLOSED, or anything beside a line feed, it can be cut there too.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CLOSED, LETTER = ",.;:!?|*$%&\n", "A-Za-z0-9À-ÖØ-öø-ÿ"
SHORT_WORD = re.compile(f"{SPACE}*(?:[{LETTER}]++(?=[{re.escape(CLOSED)}{SPACE}]|\\Z)|[^{SPACE}\n]+)|{SPACE}+|\n")
BASE = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 800_000
LAST = np.iinfo(np.int64).max


class Pieces:
    """The pieces of a model with their scores. kind: unigram or bpe."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, unknown: int, bytes_: dict[int, int] | None = None, skip: set[int] = frozenset()) -> None:
        self.pieces, self.kind, self.unknown, self.bytes = pieces, kind, unknown, bytes_ or {}
        self.library = None
        self.of_byte = {i: b for b, i in self.bytes.items()}
        usable = [i for i in range(len(pieces)) if i not in skip and i not in self.of_byte and pieces[i]]
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        keys = np.array([self.hash_of(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        self.scores = np.array(scores, np.float64)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self.keys >> np.uint64(44)] = True
        pairs = {pair for i in usable for pair in zip(pieces[i], pieces[i][1:], strict=False)}
        crossed = any("\n" in pair or (b in CLOSED and re.match(f"[{LETTER}]", a)) for pair in pairs for a, b in [pair])
        self.word = WORD if crossed else SHORT_WORD
        self.written = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.least = float(self.scores[self.ids].min(initial=0.0)) - 10.0

    @staticmethod
    def hash_of(piece: str) -> int:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in piece:
                h = h * BASE + spread(np.array([ord(c)], np.uint64))[0]
        return int(h)

    def look(self, h: np.ndarray) -> np.ndarray:
        """The id of each substring hash, -1 for none."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.nonzero(self.slots[h >> np.uint64(44)])
        some = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out

    def prepare(self) -> None:
        """Of a BPE model: how each piece is made by its last merge, its rank among merges, and what pairs merge to.

        The token after all pieces stands for an unknown character. Pieces must be their own encoding.
        """
        n = len(self.pieces)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.rank = np.zeros(n + 1, np.int64)
        of = {self.pieces[i]: i for i in self.ids.tolist()}
        sizes: dict[int, list[int]] = {}
        for i in self.ids.tolist():
            sizes.setdefault(len(self.pieces[i]), []).append(i)
        longer = np.array([i for size, own in sizes.items() if size > 1 for i in own], np.int64)
        self.rank[longer] = 1 + np.unique(-self.scores[longer], return_inverse=True)[1]
        pairs: dict[int, int] = {}
        for size, own in sizes.items():
            if size == 1:
                continue
            words = [self.pieces[i] for i in own]
            cuts = np.zeros(len(words), np.int64)
            if merges(words, size, self, cuts) != [[i] for i in own]:
                raise ValueError("a piece is not its own encoding")
            for i, w, cut in zip(own, words, cuts.tolist(), strict=True):
                self.left[i], self.right[i] = of[w[:cut]], of[w[cut:]]
                pairs.update({of[w[:k]] * (n + 1) + of[w[k:]]: i for k in range(1, size) if w[:k] in of and w[k:] in of})
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([self.rank[pairs[k]] for k in self.pairs.tolist()], np.int64)
        self.pair_slots = np.zeros(1 << 22, bool)
        self.pair_slots[spread(self.pairs.astype(np.uint64)) >> np.uint64(42)] = True

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of a and b, LAST where there is none."""
        code = a * len(self.rank) + b
        out = np.full(len(a), LAST)
        maybe = np.flatnonzero(self.pair_slots[spread(code.view(np.uint64)) >> np.uint64(42)])
        some = code[maybe]
        place = np.minimum(np.searchsorted(self.pairs, some), len(self.pairs) - 1)
        out[maybe] = np.where(self.pairs[place] == some, self.merged[place], LAST)
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece b after piece a as they are.

        Their merges are undone from the latest on. If ever the two pieces at the border merge, and would have done so
        before the merge undone last, then they would not be there side by side. Of equal merges the left comes first.
        """
        yes, at = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), LAST)
        while len(at):
            stay = np.flatnonzero(self.joins(a, b) >= limit)
            a, b, at = a[stay], b[stay], at[stay]
            ra, rb = self.rank[a], self.rank[b]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            whole = limit == 1  # nothing to undo on either side
            yes[at[whole]] = True
            go = np.flatnonzero(~whole)
            a, b, at, limit, undo = a[go], b[go], at[go], limit[go], undo[go]
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return yes

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file, by the sentencepiece library; the file says which kind it is of.

        Unigram models are normalized and decoded by the library; only unigram and BPE models are supported.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        made = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        kind, own = described(path)
        if kind not in ("unigram", "bpe") or (kind == "unigram" and own):
            raise ValueError(f"only unigram models without user-defined pieces and bpe models are supported: {path} ({kind})")
        model = cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kind, sp.unk_id(), made, skip)
        if kind == "unigram":
            # the library adds up single-precision scores from the text's start, which decides between equal sums
            model.library, model.word, model.scores = sp, re.compile("(?s:.+)"), model.scores.astype(np.float32)
        else:
            model.prepare()
        return model


def fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer's message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (body[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if body[at - 1] < 128:
                return value

    while at < len(body):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else number()
            yield tag >> 3, body[at : at + size]
            at += size


def described(path: str) -> tuple[str, bool]:
    """The kind of a model file, and if it has user-defined pieces."""
    kind, own = 1, False
    with open(path, "rb") as f:
        for k, v in fields(f.read()):
            if k == 2:
                kind = dict(fields(v)).get(3, 1)
            elif k == 1:
                own = own or dict(fields(v)).get(3) == 4
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind, str(kind)), own


def spread(codes: np.ndarray) -> np.ndarray:
    x = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefixes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of words of n characters (rows, n + 1), and the powers of the base."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
    c, pre, power = spread(codes), np.zeros((len(words), n + 1), np.uint64), np.ones(n + 1, np.uint64)
    power[1:] = BASE
    power = np.cumprod(power)
    for k in range(n):
        pre[:, k + 1] = pre[:, k] * BASE + c[:, k]
    return pre, power


def viterbi(words: list[str], n: int, model: Pieces) -> list[list[int]]:
    """Segmentations of the highest sum of scores; of equal sums, the longest last piece wins. Unknown characters
    cost more than any piece and come out as the unknown id."""
    pre, power = prefixes(words, n)
    rows = np.arange(len(words))
    best, back, took = np.full((len(words), n + 1), -np.inf, model.scores.dtype), np.zeros((len(words), n + 1), np.int64), np.zeros((len(words), n + 1), np.int64)
    best[:, 0] = 0
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - model.longest), end)
        ids = model.look(pre[:, [end]] - pre[:, starts] * power[end - starts])
        cost = np.where(ids >= 0, model.scores[ids], model.scores.dtype.type(-np.inf))
        cost[:, -1] = np.where(ids[:, -1] >= 0, cost[:, -1], model.least)
        total = best[:, starts] + cost
        pick = total.argmax(1)
        best[:, end], back[:, end] = total[rows, pick], starts[pick]
        took[:, end] = np.where(ids[rows, pick] >= 0, ids[rows, pick], model.unknown)
    out: list[list[int]] = [[] for _ in words]
    for r in range(len(words)):
        at = n
        while at:
            one = int(took[r, at])
            out[r] += fallback(words[r][at - 1], model)[::-1] if one == model.unknown else [one]
            at = int(back[r, at])
        out[r].reverse()
    return out


def linked(words: list[str], n: int, model: Pieces) -> list[list[int]]:
    """Segmentations of a BPE model: at each end the one piece that may follow the last piece of the text before it."""
    pre, power = prefixes(words, n)
    rows, unknown = np.arange(len(words)), len(model.pieces)
    last, back = np.full((len(words), n + 1), -1), np.zeros((len(words), n + 1), np.int64)
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - model.longest), end)
        ids = model.look(pre[:, [end]] - pre[:, starts] * power[end - starts])
        ids[:, -1] = np.where(ids[:, -1] < 0, unknown, ids[:, -1])
        may = ids >= 0
        r, k = np.nonzero(may & (starts > 0))
        may[r, k] = model.follows(last[r, starts[k]], ids[r, k])
        pick = may.argmax(1)
        last[:, end], back[:, end] = ids[rows, pick], starts[pick]
    # all words go back together, a piece a round
    out: list[list[int]] = [[] for _ in words]
    at, live = np.full(len(words), n), rows
    while len(live):
        one, start = last[live, at], back[live, at]
        for w, i, b in zip(live.tolist(), one.tolist(), start.tolist(), strict=True):
            out[w] += [i] if i != unknown else fallback(words[w][b], model)[::-1]
        live, at = live[start > 0], start[start > 0]
    return [x[::-1] for x in out]


def merges(words: list[str], n: int, model: Pieces, cuts: np.ndarray | None = None) -> list[list[int]]:
    """Rounds of merges: in every word the adjacent pair that makes the piece of the highest score, the left of equals.

    The definition of BPE; it tells how pieces are made. cuts: takes the place of each word's last merge.
    """
    pre, power = prefixes(words, n)
    rows = np.arange(len(words))
    nxt = np.tile(np.arange(1, n + 2), (len(words), 1))  # where the symbol that starts here ends
    alive = np.ones((len(words), n), bool)  # symbols start here

    def pair(r: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The score of merging the symbol at start with the one after it; -inf for no piece."""
        mid = nxt[r, start]
        inside = mid < n
        end = np.where(inside, nxt[r, np.minimum(mid, n)], n)
        ids = model.look(pre[r, end] - pre[r, start] * power[end - start])
        return np.where(inside & (ids >= 0), model.scores[ids], -np.inf)

    score = pair(np.repeat(rows, n), np.tile(np.arange(n), len(words))).reshape(len(words), n)
    live = rows
    while len(live):
        at = score[live].argmax(1)
        live, at = (x[np.isfinite(score[live, at])] for x in (live, at))
        if not len(live):
            break
        mid = nxt[live, at]
        if cuts is not None:
            cuts[live] = mid
        nxt[live, at] = nxt[live, mid]
        alive[live, mid], score[live, mid] = False, -np.inf
        score[live, at] = pair(live, at)
        before = alive[live] & (np.arange(n) < at[:, None])
        has = before.any(1)
        left = n - 1 - before[:, ::-1].argmax(1)
        score[live[has], left[has]] = pair(live[has], left[has])
    r, start = np.nonzero(alive)
    end = nxt[r, start]
    ids = model.look(pre[r, end] - pre[r, start] * power[end - start])
    flat, cuts = ids.tolist(), np.searchsorted(r, np.arange(len(words) + 1)).tolist()
    out = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for w in np.unique(r[ids < 0]).tolist():  # words with characters that no piece has
        at = slice(cuts[w], cuts[w + 1])
        out[w] = [y for a, b, i in zip(start[at], end[at], flat[at], strict=True) for y in ([i] if i >= 0 else fallback(words[w][a:b], model))]
    return out


def fallback(char: str, model: Pieces) -> list[int]:
    return [model.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if model.bytes else [model.unknown]


class Codec:
    def __init__(self, model: Pieces, prefix: bool = True) -> None:
        self.model, self.prefix, self.known = model, prefix, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; an empty text has none."""
        if self.model.library:
            self.known.clear()  # whole texts
            parts = [self.model.word.findall(self.model.library.normalize(t)) for t in texts]
        else:
            parts = [self.model.word.findall((SPACE if self.prefix and t else "") + t.replace(" ", SPACE)) for t in texts]
        fresh = {p for ps in parts for p in ps}.difference(self.known)
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
            fresh = {p for ps in parts for p in ps}
        sizes: dict[int, list[str]] = {}
        for p in fresh:
            sizes.setdefault(len(p), []).append(p)
        solve = viterbi if self.model.kind == "unigram" else linked
        for n, words in sizes.items():
            step = max(1, (1 << 20) // n)
            for at in range(0, len(words), step):
                part = words[at : at + step]
                self.known.update(zip(part, (np.array(x, "<u4").tobytes() for x in solve(part, n, self.model)), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, ps)), "<u4") for ps in parts]
        if self.model.library:  # it gives one id for unknown characters in a row
            out = [x[~((x == self.model.unknown) & (np.concatenate(([-1], x[:-1].astype(np.int64))) == self.model.unknown))] for x in out]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are put together, the mark is a space, and the prefix goes."""
        if self.model.library:
            return self.model.library.decode(ids.tolist())
        text = b"".join(map(self.model.written.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Pieces.load(path))
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text and the text made from them again.

    A null or empty text has no ids. Texts that hold the space mark U+2581 itself decode with spaces in its place.
    Every row is coded alone; an empty table gives an empty result. Texts may be of any length.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for x in batches:
            for at in range(0, len(x), 512):
                part = x.iloc[at : at + 512]
                ids = coder.encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [i.astype(np.int32) for i in ids], "decoded": [coder.decode(i) for i in ids]})

    return id_and_text(docs, id_col, text_col).mapInPandas(of, "doc_id long, ids array<int>, decoded string")


def summaries(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256): encoded(), with ids and texts as digests."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for x in batches:
            for at in range(0, len(x), 512):
                part = x.iloc[at : at + 512]
                ids = coder.encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids], "decoded": [coder.decode(i) for i in ids]})

    out = id_and_text(docs, id_col, text_col).mapInPandas(of, "doc_id long, n_tokens long, ids_crc32 long, decoded string")
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))
