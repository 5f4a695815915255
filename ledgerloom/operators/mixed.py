"""Documents of any format, read in one pass: formats of one element tree share a parse, formats of equal nodes their columns."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.names import snake
from ledgerloom.operators.reader import NOTES, STATUS, VALUE, Element, parsed, quoted, read_notes, read_values
from ledgerloom.plans.mapping import Compiled, Spoke


def tree(e: Element) -> tuple:
    """What an element holds, as a value that can be compared."""
    return tuple(sorted((k, tree(c)) for k, c in e.children.items())), tuple(sorted(e.attributes)), e.text, e.many


def grouped(spokes: list[Spoke], by: Callable[[Spoke], Hashable]) -> list[list[Spoke]]:
    """Formats that are the same in some respect, in order of their first."""
    out: dict[Hashable, list[Spoke]] = {}
    for s in spokes:
        out.setdefault(by(s), []).append(s)
    return list(out.values())


def nodes_of(s: Spoke, told: bool) -> str:
    """The nodes of a format, as text to compare; without `told`, apart from what only diagnostics depend on."""
    return repr([n if told else replace(n, required=False, min_items=None, description=None) for _, n in sorted(s.nodes.items())])


def equal_plans(spokes: list[Spoke]) -> list[list[Spoke]]:
    """Formats whose documents are read and checked alike, whatever their names."""
    return grouped(spokes, lambda s: (s.root, nodes_of(s, True)))


def column_type(c: Compiled, label: str) -> str:
    """The type of a canonical field as a column."""
    kind = c.fields[label]
    if kind != "collection":
        return "boolean" if kind == "boolean" else "string"
    inner = [k for k in c.fields if k.rpartition("/")[0] == label]
    return "array<struct<" + ",".join(f"{snake(k.rpartition('/')[2])}:{column_type(c, k)}" for k in sorted(inner)) + ">>"


def filled(c: Compiled, label: str, value: Column | None) -> Column:
    """A field as every format has it: fields that one lacks are null in its records."""
    kind = column_type(c, label)
    if value is None:
        return (F.array() if kind.startswith("array") else F.lit(None)).cast(kind)
    return value


def whole_items(c: Compiled, label: str, spoke: Spoke, value: Column) -> Column:
    """A collection's items with all canonical fields, in their order."""
    inner = sorted(k for k in c.fields if k.rpartition("/")[0] == label)
    has = set(map(spoke.label, spoke.keyed()))

    def item(x: Column) -> Column:
        parts = []
        for k in inner:
            name = snake(k.rpartition("/")[2])
            own = x[name] if k in has else None
            if own is not None and c.fields[k] == "collection":
                own = whole_items(c, k, spoke, own)
            parts.append(filled(c, k, own).alias(name))
        return F.struct(*parts)

    return F.transform(value, lambda x: item(x))


def flat_mixed(found: DataFrame, c: Compiled, xml: str = "xml", strict: bool = True, spoke_col: str = "spoke") -> tuple[DataFrame, list[str]]:
    """found, whose `spoke_col` names each document's format, with STATUS, NOTES and a column VALUE + name for each
    canonical field at the top; and the names. The status is null where the format is none of these.
    """
    of = F.col(quoted(spoke_col))
    names, out = [F.col(quoted(x)) for x in found.columns], found
    trees = []
    for k, own in enumerate(grouped(c.spokes, lambda s: (s.root, tree(Element.of(s))))):
        out, top = parsed(out, own[0], xml, strict, of.isin([s.id for s in own]), f"_ledgerloom_tree{k}", f"_ledgerloom_said{k}")
        trees.append((own, top, F.col(f"_ledgerloom_tree{k}"), F.col(f"_ledgerloom_said{k}")))

    def chosen(pairs: list[tuple[list[Spoke], Column]]) -> Column:
        """The value that goes with a document's format; null for formats that are none of these."""
        return F.coalesce(*[F.when(of.isin([s.id for s in own]), value) for own, value in pairs])

    out = out.withColumn(STATUS, chosen([(own, said) for own, _, _, said in trees]))
    ok, labels = F.col(STATUS) == "ok", sorted(k for k in c.fields if "/" not in k)
    values: dict[str, list] = {k: [] for k in labels}
    notes = []
    for own, top, at, _ in trees:
        notes += [(some, read_notes(some[0], None, at, top, None)) for some in grouped(own, lambda s: nodes_of(s, True))]
        for some in grouped(own, lambda s: nodes_of(s, False)):
            fields = read_values(some[0], None, at, top)
            for k in labels:
                value = fields.get(snake(k))
                if value is not None and c.fields[k] == "collection":
                    value = whole_items(c, k, some[0], value)
                values[k].append((some, filled(c, k, value)))
    fields = [F.when(ok, chosen(values[k])).alias(VALUE + snake(k)) for k in labels]
    told = F.when(ok, chosen(notes)).otherwise(X.diagnostics([])).alias(NOTES)
    return out.select(*names, STATUS, told, *fields), [snake(k) for k in labels]
