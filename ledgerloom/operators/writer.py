"""The canonical record to XML: a struct of exactly the elements that have a value, rendered by to_xml."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.names import snake, xml_snake
from ledgerloom.operators.reader import below, quoted
from ledgerloom.plans.mapping import Node, Spoke


def built(tree: dict) -> tuple[Column, list[Column]]:
    """A struct of a tree of columns, null if all of its leaves are; and the leaves. Fields go by their snake-case names."""
    fields, leaves = [], []
    for name in sorted(tree, key=lambda k: (not k.startswith("_"), xml_snake(k))):
        value = tree[name]
        if isinstance(value, dict):
            c, own = (value["_VALUE"], [value["_VALUE"]]) if set(value) == {"_VALUE"} else built(value)
        else:
            c, own = value, [value]
        fields.append(c.alias(name))
        leaves += own
    return F.when(F.coalesce(*[F.when(x.isNotNull(), True) for x in leaves]), F.struct(*fields)), leaves


def put(tree: dict, steps: tuple[str, ...], value: Column) -> None:
    for step in steps:
        if step.startswith("@"):
            tree["_" + step[1:]] = value
            return
        if step == "$text":
            break
        tree = tree.setdefault(step, {})
    tree["_VALUE"] = value


def write_scope(spoke: Spoke, scope: str | None, hub: Column | dict[str, Column], has: set[str], prefix: str, index: Column | None) -> tuple[Column, list[X.Told], list[Column]]:
    """The element of one scope, its diagnostics, and those of its collections. has: labels the record has."""
    tree: dict = {}
    constants: list[tuple[tuple[str, ...], Column]] = []
    told: list[X.Told] = []
    nested: list[Column] = []
    nodes = spoke.inside(scope)
    for n in nodes:
        if n.type == "collection" or not (n.canonical_key or n.clone_of or n.constant is not None):
            continue
        if n.constant is not None:
            constants.append((below(spoke, n), F.lit(n.constant)))
            continue
        key = n.clone_of or n.canonical_key
        known = prefix + key in has
        value = X.render(hub[snake(key)], n.type) if known else F.lit(None).cast("string")
        if known:
            put(tree, below(spoke, n), F.when(F.length(value) > 0, value))
        if n.required and not n.clone_of:
            told.append(X.diagnostic(F.coalesce(F.length(value), F.lit(0)) == 0, "error", "REQUIRED_MISSING", n.id, key, n.source_path, "required value is missing", index))
    for n in nodes:
        if n.type != "collection" or not n.canonical_key:
            continue
        if prefix + n.canonical_key in has:

            def element(e: Column, i: Column, n: Node = n) -> Column:
                return write_scope(spoke, n.id, e, has, f"{prefix}{n.canonical_key}/", i)[0]

            def notes(e: Column, i: Column, n: Node = n) -> Column:
                _, own, more = write_scope(spoke, n.id, e, has, f"{prefix}{n.canonical_key}/", i)
                return F.concat(X.diagnostics(own), *more) if more else X.diagnostics(own)

            values = hub[snake(n.canonical_key)]
            items = F.filter(F.transform(values, _two(element)), lambda x: x.isNotNull())
            if told_of(spoke, n.id):
                nested.append(F.coalesce(F.flatten(F.transform(values, _two(notes))), X.diagnostics([])))
            count = F.coalesce(F.size(items), F.lit(0))
            place = tree
            for step in below(spoke, n)[:-1]:
                place = place.setdefault(step, {})
            place[below(spoke, n)[-1]] = F.when(count > 0, items)
        else:
            count = F.lit(0)
        if n.least:
            message = F.concat(F.lit(f"collection `{n.canonical_key}` has "), count, F.lit(f" items, expected at least {n.least}"))
            nested.append(X.diagnostics([X.diagnostic(count < n.least, "error", "MIN_ITEMS", n.id, n.canonical_key, n.source_path, message)]))
    if scope is None:
        for steps, value in constants:
            put(tree, steps, value)
        return (built(tree)[0] if tree else F.lit(None)), told, nested
    if not tree:
        return F.lit(None).cast("string"), told, nested
    # in a collection, constants stand only in items that have something else
    some = built(tree)[0].isNotNull()
    for steps, value in constants:
        put(tree, steps, F.when(some, value))
    return built(tree)[0], told, nested


def _two(f):
    return lambda e, i: f(e, i)


def told_of(spoke: Spoke, scope: str) -> bool:
    """Whether writing the items of a collection can tell a diagnostic at all."""
    return any((n.required and not n.clone_of and n.constant is None) or n.least or (n.type == "collection" and told_of(spoke, n.id)) for n in spoke.inside(scope))


def labels(schema, prefix: str = "") -> set[str]:
    """The column paths of a record's schema, in snake case."""
    out = set()
    for f in schema.fields:
        out.add(prefix + f.name)
        inner = getattr(f.dataType, "elementType", None)
        if inner is not None and hasattr(inner, "fields"):
            out |= labels(inner, f"{prefix}{f.name}/")
    return out


def from_hub(docs: DataFrame, spoke: Spoke, hub: str = "hub", to: str = "xml_out") -> DataFrame:
    """docs with one more column of XML text, and write_diagnostics; both null or empty where the record is null."""
    h = F.col(quoted(hub))
    names = [c for c in docs.columns if c not in (to, "write_diagnostics")]
    return written(docs, spoke, h, labels(docs.schema[hub].dataType), h.isNotNull(), names, to, "write_diagnostics")


def written(docs: DataFrame, spoke: Spoke, hub: Column | dict[str, Column], columns: set[str], there: Column, names: list[str], to: str, notes_to: str) -> DataFrame:
    """The columns `names` of docs, the XML text and the diagnostics, where `there` holds.

    columns: the paths of the record's fields. A document is only rendered, and its notes only made, if they are selected.
    """
    has = {name for name in map(spoke.label, spoke.keyed()) if "/".join(snake(k) for k in name.split("/")) in columns}
    element, told, nested = write_scope(spoke, None, hub, has, "", None)
    notes = F.concat(X.diagnostics(told), *nested) if nested else X.diagnostics(told)
    xml = F.when(there, F.to_xml(element, {"rowTag": spoke.root, "indent": "", "attributePrefix": "_", "valueTag": "_VALUE"}))
    return docs.select(*[F.col(quoted(c)) for c in names], xml.alias(to), F.when(there, notes).otherwise(X.diagnostics([])).alias(notes_to))
