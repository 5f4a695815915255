"""Which format a document has: by its root element, then by marks in its CustomizationID."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import trim
from ledgerloom.plans.mapping import Spoke

ROOT = r"(?s)\A(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>)*<(?:[^\s<>/:!?]+:)?([^\s<>/:!?]+)"
#: What no text is read from; it is replaced by GAP, which parts texts as it did.
UNREAD, GAP = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "<!>"
#: The first text after the start of such an element, past what is empty.
CUSTOMIZATION = r"<(?:[^\s<>/:!?]+:)?CustomizationID(?:\s(?:[^>]*[^>/])?)?>(?:\s|<!>|<[^\s<>/!?][^<>]*/>)*([^<]*[^\s<])"


def root_name(xml: Column) -> Column:
    """The local name of the first element; empty for what isn't XML."""
    return F.regexp_extract(xml, ROOT, 1)


def customization(xml: Column) -> Column:
    """The first CustomizationID with text of its own, trimmed; empty without any. Comments, CDATA sections and processing
    instructions are no text."""
    read = F.when(F.contains(xml, F.lit("<!")) | F.contains(xml, F.lit("<?")), F.regexp_replace(xml, UNREAD, GAP)).otherwise(xml)
    return F.when(F.contains(xml, F.lit("CustomizationID")), trim(F.regexp_extract(read, CUSTOMIZATION, 1))).otherwise("")


def detected(xml: Column, spokes: list[Spoke]) -> Column:
    """The id of the document's format, or `unknown` or `ambiguous`.

    Formats of that root whose mark stands in the CustomizationID come first, then those without marks; the only one
    with that root needs no mark. Exactly one must remain.
    """
    root, mark = root_name(xml), F.lower(customization(xml))
    out = F.lit("unknown")
    for name in sorted({s.root for s in spokes}):
        own = [s for s in spokes if s.root == name]
        if len(own) == 1:
            answer = F.lit(own[0].id)
        else:
            marked = lambda s: F.coalesce(*[F.when(F.contains(mark, F.lit(m)), s.id) for m in s.markers])
            hits = F.array_compact(F.array(*[marked(s) for s in own if s.markers]).cast("array<string>"))
            rest = [s.id for s in own if not s.markers]
            fallback = F.lit(rest[0] if len(rest) == 1 else "ambiguous")
            answer = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) > 1, F.lit("ambiguous")).otherwise(fallback)
        out = F.when(root == name, answer).otherwise(out)
    return out
