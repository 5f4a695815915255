"""Scalar rules as Spark columns: normalising, checking and rendering values, and building diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexical shapes by type; the date shape has no calendar, so 30 February passes.
DATE = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
SHAPES = {
    "currency": r"^[A-Z]{3}\z",
    "unit_code": r"^[0-9A-Za-z]{1,3}\z",
    "date": rf"^{DATE}\z",
    "datetime": rf"(?s)^{DATE}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(Z|[.+-].*)?\z",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)\z",
    "boolean": r"^(true|false)\z",
}
SPOKEN = {"currency": "currency code", "unit_code": "unit code", "date": "date", "datetime": "date-time", "decimal": "decimal", "boolean": "boolean"}

DIAGNOSTIC = "struct<severity:string,code:string,source_node:string,canonical_key:string,source_path:string,collection_index:int,fallback_chain:array<string>,message:string>"


#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE))


NORMALISERS = {"trim": trim, "uppercase": F.upper, "lowercase": F.lower, "empty_as_missing": lambda c: F.nullif(c, F.lit(""))}


@dataclass(frozen=True)
class Adapter:
    """A named conversion of a text; failure gives the reason why a text can't be converted, null where it can."""

    apply: Callable[[Column], Column]
    failure: Callable[[Column], Column] | None = None


#: All that mapping files may name; register() adds to it.
ADAPTERS: dict[str, Adapter] = {}


def register(name: str, apply: Callable[[Column], Column], failure: Callable[[Column], Column] | None = None) -> None:
    """Offer an adapter to mapping files that are compiled from now on. Both functions build columns of built-in functions."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is registered already")
    ADAPTERS[name] = Adapter(apply, failure)


register("uppercase_currency", F.upper)


def normalise(c: Column, ops: list[str]) -> Column:
    for op in ops:
        c = NORMALISERS[op](c)
    return c


def valid(c: Column, kind: str) -> Column:
    """Whether the trimmed text has the shape of its type; strings and identifiers always have."""
    return trim(c).rlike(SHAPES[kind]) if kind in SHAPES else c.isNotNull()


def decode(c: Column, kind: str) -> Column:
    """The stored value, null if invalid: checks look at the trimmed text, but all types except decimal and boolean
    keep the text as it is. A decimal stays canonical text, with the digits that were written."""
    if kind == "decimal":
        return F.when(valid(c, kind), F.regexp_replace(trim(c), r"^\+", ""))
    if kind == "boolean":
        return F.when(valid(c, kind), trim(c) == "true")
    return F.when(valid(c, kind), c)


def render(c: Column, kind: str) -> Column:
    return c.cast("string") if kind == "boolean" else c


@dataclass(frozen=True)
class Told:
    """A diagnostic that is told of a row where `when` holds."""

    when: Column
    entry: Column


def diagnostic(
    when: Column, severity: str, code: str, node: str, key: str | None, path: str | None, message: Column | str, index: Column | None = None, fallbacks: list[str] | None = None
) -> Told:
    text = lambda x: F.lit(x).cast("string")
    entry = F.struct(
        text(severity).alias("severity"),
        text(code).alias("code"),
        text(node).alias("source_node"),
        text(key).alias("canonical_key"),
        text(path).alias("source_path"),
        (index if index is not None else F.lit(None)).cast("int").alias("collection_index"),
        (F.array(*[F.lit(x) for x in fallbacks or []])).cast("array<string>").alias("fallback_chain"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )
    return Told(when, entry)


def diagnostic_line(d: Column) -> Column:
    """`level [CODE] node: message`."""
    return F.format_string("%s [%s] %s: %s", d["severity"], d["code"], d["source_node"], d["message"])


def diagnostics(entries: list[Told]) -> Column:
    """The entries that are told, in their order. Most rows have none, and for them only the conditions are looked at."""
    none = F.array().cast(f"array<{DIAGNOSTIC}>")
    if not entries:
        return none
    some = reduce(lambda a, b: a | b, [t.when for t in entries])
    return F.when(some, F.array_compact(F.array(*[F.when(t.when, t.entry) for t in entries]))).otherwise(none)
