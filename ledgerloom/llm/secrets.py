"""Secret scans in built-in functions: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A candidate string's score is the sum over its adjacent characters of the logarithm of the two models'
likelihood ratio; the table of these ratios (one number for each pair of alphabet characters, so of fixed size) is a
constant of the Spark expression. A candidate that is not a secret as a whole can hold some, as in NAME=value: its
stretches of high sums are judged by the same two limits.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, running

#: The kinds of the contract in their order, with what a match needs besides.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these characters is taken whole by the base patterns, so asking for the length at once finds the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: A candidate is a secret if its ratio exceeds this many nats in all, and this many for each pair.
LEAST_TOTAL, LEAST_MEAN = 16.0, 0.35
#: A stretch of a candidate ends at "=" and where its sum falls so many nats below its highest; it is widened up to one of
#: "=/_-" or the candidate's ends, padding of "=" included, and then has this many characters at least.
DROP, LEAST_LENGTH = 8.0, 16
BEFORE, AFTER = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*+$", r"^[A-Za-z0-9+]*+(?:={1,2}$)?"
PAIRS = "array<struct<a:int,b:int>>"
SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"

#: Parts that ordinary identifiers and words are made of.
WORDS = """account address amount array average balance base batch block buffer build cache call category change channel check
client column comment config connect content context control count create current customer data date default delete detail
device document domain element email entry error event export field file filter first format function group handle hash
header height history image import index info input invoice item label last length level limit line list load local location
manager map message method model module name network node number object offset option order output package page parameter
parent part path payment plan point policy position price process product profile project property query queue range record
reference region remove report request resource response result return role route row sample schema score section select
server service session setting shape sign size source stage start state status step store stream string style system table
target task template test text thread time title total trace track transaction type unit update user value vector version
view weight window word write lich keit ung schaft verein mente cion ado tion ement ouvert elle aux entre para como donde
nicht durch zwischen erste straße welt gen stand ther with that ness able ing other where should""".split()


def labelled_samples(seed: int = 11, n: int = 4000) -> list[tuple[str, int]]:
    """(string, 1 if random else 0): random strings in usual alphabets, and identifiers joined from WORDS."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + "0123456789", ALPHABET[26:62]]
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(20, 48))), 1) for _ in range(n)]
    for _ in range(n):
        words = [w for w in r.choices(WORDS, k=r.randint(2, 6))]
        style = r.randrange(7)
        joined = [
            "_".join(words),
            "".join(w.title() for w in words),
            words[0] + "".join(w.title() for w in words[1:]),
            "-".join(words),
            "_".join(words).upper(),
            "/".join(words),
            "".join(words),
        ][style]
        out.append((joined + (str(r.randint(0, 2030)) if r.random() < 0.2 else ""), 0))
    for _ in range(n // 4):  # rulers and padding
        out.append((r.choice("-_=/+0") * r.randint(4, 40), 0))
    for _ in range(n // 3):  # abbreviations among the words
        short, words = "".join(r.choices("BCDFGHKLMNPRSTVXAEIO", k=r.randint(2, 4))), r.choices(WORDS, k=r.randint(1, 3))
        joined = ["_".join([short, *words]).upper(), words[0].title() + short + "".join(w.title() for w in words[1:]), "-".join(words) + f"-{r.randint(0, 99)}", "/".join([*words, short])]
        out.append((r.choice(joined), 0))
    return out


def trained(samples: list[tuple[str, int]], alphabet: str = ALPHABET) -> list[float]:
    """ln P(b | a, random) - ln P(b | a, ordinary) for all pairs of the alphabet, row by row, from add-half counts."""
    k, at = len(alphabet), {c: i for i, c in enumerate(alphabet)}
    counts = [[0.5] * (k * k) for _ in range(2)]
    for text, label in samples:
        codes = [at[c] for c in text if c in at]
        for a, b in zip(codes, codes[1:], strict=False):
            counts[label][a * k + b] += 1
    out = []
    for a in range(k):
        rows = [c[a * k : a * k + k] for c in counts]
        sums = [sum(row) for row in rows]
        out += [math.log(rows[1][b] / sums[1]) - math.log(rows[0][b] / sums[0]) for b in range(k)]
    return out


@cache
def default_table() -> tuple[float, ...]:
    return tuple(trained(labelled_samples()))


def pair_scores(token: Column, table: list[float], alphabet: str = ALPHABET) -> Column:
    """array<struct<score, cut>>: the log-likelihood ratio of each pair of adjacent characters; cut: one of them is "="."""
    k = len(alphabet)
    constant = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    equals = alphabet.find("=")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    pairs = F.greatest(F.length(token) - 1, F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(codes, F.lit(1), pairs).alias("a"), F.slice(codes, F.lit(2), pairs).alias("b")),
        lambda p: F.struct(F.coalesce(F.get(constant, p["a"] * k + p["b"]), F.lit(0.0)).alias("score"), ((p["a"] == equals) | (p["b"] == equals)).alias("cut")),
    )


def enough(total: Column, pairs: Column) -> Column:
    return (total > LEAST_TOTAL) & (total > LEAST_MEAN * pairs)


def stretches(scores: Column, token: Column) -> Column:
    """array<struct<a, b>>: the places of the stretches of token that are secrets, in one pass over its pairs' scores."""
    none = F.array().cast(PAIRS)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("a"), F.lit(0).alias("b"), none.alias("out"))

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))
        return F.when(enough(acc["peak"], acc["b"] - acc["a"] - 1), F.concat(acc["out"], one)).otherwise(acc["out"])

    def add(acc: Column, p: Column) -> Column:
        total, after = acc["sum"] + p["score"], acc["at"] + 1
        shut, up = p["cut"] | (total <= 0) | (total < acc["peak"] - DROP), total > acc["peak"]
        return F.struct(
            after.alias("at"),
            F.when(shut, 0.0).otherwise(total).alias("sum"),
            F.when(shut, 0.0).otherwise(F.greatest(total, acc["peak"])).alias("peak"),
            F.when(shut, after).otherwise(acc["a"]).alias("a"),
            F.when(shut, after).when(up, acc["at"] + 2).otherwise(acc["b"]).alias("b"),
            F.when(shut, closed(acc)).otherwise(acc["out"]).alias("out"),
        )

    def widened(m: Column) -> Column:
        left = F.length(F.regexp_extract(F.substring(token, F.lit(1), m["a"]), BEFORE, 0))
        right = F.length(F.regexp_extract(F.substring(token, m["b"] + 1, F.length(token)), AFTER, 0))
        return F.struct((m["a"] - left).alias("a"), (m["b"] + right).alias("b"))

    def merged(out: Column, m: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joint = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], m["b"]).alias("b")))
        return F.when(m["a"] <= last["b"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), joint)).otherwise(F.concat(out, F.array(m)))

    every = F.aggregate(F.transform(F.aggregate(scores, start, add, closed), widened), none, merged)
    return F.filter(every, lambda m: m["b"] - m["a"] >= LEAST_LENGTH)


def outside(spans: Column, base: Column) -> Column:
    """The parts of each of spans (a, b) that none of base, sorted by start, covers."""
    none = F.array().cast(PAIRS)

    def parts(m: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("a"), b["start"].alias("b")))
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

        def rest(acc: Column) -> Column:
            return F.when(acc["at"] < m["b"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), m["b"].alias("b"))))).otherwise(acc["out"])

        over = F.filter(base, lambda b: (b["start"] < m["b"]) & (m["a"] < b["end"]))
        return F.aggregate(over, F.struct(m["a"].alias("at"), none.alias("out")), add, rest)

    return F.flatten(F.transform(spans, parts))


def places(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, hit>> of all leftmost non-overlapping matches, in code points.

    The texts between the matches and the matches themselves, in turn, make up the text; their lengths add up to the
    places. Both come from one pattern, so they agree.
    """
    empty = F.array().cast(SPANS)

    def found(hits: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
        return let(steps, lambda xs: let(running(F.transform(xs, lambda x: (x["gap"] + x["size"]).cast("long")), lambda a, b: a + b, F.lit(0).cast("long")), lambda before: placed(xs, before)))

    def placed(xs: Column, before: Column) -> Column:
        def one(x: Column, at: Column) -> Column:
            start = at.cast("int") + x["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["hit"].alias("hit"))

        return F.zip_with(xs, before, one)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, found(hits)).otherwise(empty))


def leading(spans: Column, holds: Callable[[Column], Column]) -> Column:
    """How many of spans, from the first on, `holds` is true of; found by halving, for after them it is false."""

    def halved(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]

        def step(mid: Column) -> Column:
            yes = holds(F.get(spans, mid))
            return F.struct(F.when(yes, mid + 1).otherwise(low).alias("low"), F.when(yes, high).otherwise(mid).alias("high"))

        return F.when(low < high, let(F.shiftright(low + high, 1), step)).otherwise(acc)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halved, lambda acc: acc["low"])


def overlapping(spans: Column, m: Column) -> Column:
    """Those of spans, which are in order and don't overlap each other, that overlap m."""
    first, after = leading(spans, lambda s: s["end"] <= m["start"]), leading(spans, lambda s: s["start"] < m["end"])
    some = lambda a: let(after, lambda z: F.when(a < z, F.transform(F.sequence(a, z - 1), lambda k: F.get(spans, k))).otherwise(F.array().cast(SPANS)))
    return F.when(F.size(spans) > 0, let(first, some)).otherwise(F.array().cast(SPANS))


def with_spans(docs: DataFrame, to: str = "spans", table: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with one more column: array<struct<start, kind, end>> sorted by start, then kind, then end.

    kind counts KINDS from 0; ends are exclusive, in code points of the whole text. A null or empty text has no
    spans. Of a Markov span that overlaps a fixed pattern's, only the parts outside are given. Every row is scanned
    alone; an existing column of the name `to` is replaced. Texts may be of any length; time grows with the matches of one to
    the power 1.5.
    """
    table = list(table or default_table())
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    t = "_ledgerloom_"
    assigned = F.filter(places(F.col(t + "text"), ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 12)
    out = docs.withColumn(t + "text", text)
    out = out.withColumns({t + "0": assigned, t + "1": F.when(F.contains(F.col(t + "text"), F.lit("AKIA")), places(F.col(t + "text"), ACCESS, 1)), t + "2": places(F.col(t + "text"), HEX, 2), t + "3": places(F.col(t + "text"), CANDIDATE, 3)})
    # the spans of a kind don't overlap each other
    kinds = [F.coalesce(F.col(t + k), F.array().cast(SPANS)) for k in "012"]

    def strange(m: Column) -> Column:
        base = F.sort_array(F.concat(*[overlapping(k, m) for k in kinds]))

        def judged(scores: Column) -> Column:
            total = F.aggregate(scores, F.lit(0.0), lambda acc, p: acc + p["score"])
            whole = F.array(F.struct(m["start"].alias("a"), m["end"].alias("b")))
            some = F.transform(stretches(scores, m["hit"]), lambda s: F.struct((m["start"] + s["a"]).alias("a"), (m["start"] + s["b"]).alias("b")))
            return let(base, lambda b: F.when((F.size(b) == 0) & enough(total, F.size(scores)), whole).otherwise(outside(some, b)))

        return F.transform(let(pair_scores(m["hit"], table), judged), lambda s: F.struct(s["a"].alias("start"), F.lit(3).alias("kind"), s["b"].alias("end"), m["hit"].alias("hit")))

    every = F.concat(*kinds, F.flatten(F.transform(F.col(t + "3"), strange)))
    spans = F.transform(F.sort_array(every), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    names = [F.col(quoted(c)) for c in docs.columns if c != to]
    return out.select(*names, spans.alias(to))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kinds, m["kind"]), m["start"], m["end"])), ",")


def secrets(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of docs; see with_spans."""
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    s = F.col("spans")
    n = lambda kind: F.size(F.filter(s, lambda m: m["kind"] == kind)).cast("long")
    return with_spans(base, "spans", table).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(written_out(F.filter(s, lambda m: m["kind"] < 3)), 256).alias("base_sha256"),
        written_out(s).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", table: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text column replaced by `mark`; overlapping secrets become one mark."""
    spans, text = F.col("_ledgerloom_spans"), F.col(quoted(text_col))

    def body(length: Column, size: Column, parts: Column) -> Column:
        """The text of so many characters, given in parts of `size`, without the spans."""

        def cut(a: Column, b: Column) -> Column:
            some = F.transform(F.sequence(F.floor(a / size), F.floor((b - 1) / size)), lambda k: F.substring(F.get(parts, k.cast("int")), (F.greatest(a - k * size, F.lit(0)) + 1).cast("int"), (F.least(b, (k + 1) * size) - F.greatest(a, k * size)).cast("int")))
            return F.when(a < b, F.array_join(some, "")).otherwise("")

        ends = running(F.transform(spans, lambda m: m["end"].cast("long")), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
        pieces = F.zip_with(spans, ends, lambda m, at: F.when(m["start"] >= at, F.concat(cut(at.cast("int"), m["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda m: m["end"])), length))

    # a substring's place is counted from the start of its text, so the text is cut into parts first; a length is counted too
    parts = lambda length, size: F.transform(F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, size))
    made = let(F.length(text), lambda length: let(F.ceil(8 * F.sqrt(length.cast("double"))).cast("int"), lambda size: let(parts(length, size), lambda some: body(length, size, some))))
    out = with_spans(docs, "_ledgerloom_spans", table, text_col)
    return out.withColumn(text_col, F.when(F.size(spans) > 0, made).otherwise(text)).select(*[F.col(quoted(c)) for c in docs.columns])
