"""XML to the canonical record: one parse with a schema of exactly the mapped elements, then plain projections.

Every element is parsed as an array, so that one that is repeated against its mapping is seen, not silently dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.functions.names import snake
from ledgerloom.plans.mapping import Node, Spoke

OPTIONS = {
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "false",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "attributePrefix": "_",
    "valueTag": "_VALUE",
}


class Element:
    """The elements that a mapping speaks of, as a tree."""

    def __init__(self) -> None:
        self.children: dict[str, Element] = {}
        self.attributes: set[str] = set()
        self.text = False
        self.many = False

    @classmethod
    def of(cls, spoke: Spoke) -> Element:
        top = cls()
        for n in spoke.nodes.values():
            at = top
            for step in n.path:
                if step.startswith("@"):
                    at.attributes.add(step[1:])
                elif step == "$text":
                    at.text = True
                else:
                    at = at.children.setdefault(step, cls())
            if n.type == "collection" or n.multiple:
                at.many = True
            if n.type != "collection" and not n.path[-1].startswith("@"):
                at.text = True
        return top

    @property
    def plain(self) -> bool:
        return not self.children and not self.attributes

    def schema(self) -> T.DataType:
        if self.plain:
            return T.StringType()
        fields = [T.StructField("_" + a, T.StringType()) for a in sorted(self.attributes)]
        fields += [T.StructField("_VALUE", T.StringType())] if self.text else []
        fields += [T.StructField(k, T.ArrayType(e.schema())) for k, e in sorted(self.children.items())]
        return T.StructType(fields)


def leaf(base: Column, top: Element, steps: tuple[str, ...], whole: bool = False) -> Column:
    """The text at a path below base, null where an element is missing; with `whole`, all texts of its last element."""
    at, c = top, base
    for k, step in enumerate(steps):
        if step.startswith("@"):
            return c[f"_{step[1:]}"]
        if step == "$text":
            return c if at.plain else c["_VALUE"]
        at = at.children[step]
        if whole and k == len(steps) - 1:
            return c[step]
        c = F.get(c[step], F.lit(0))
    return c if at.plain else c["_VALUE"]


def below(spoke: Spoke, n: Node) -> tuple[str, ...]:
    """A node's path from the collection around it."""
    return n.path[len(spoke.nodes[n.scope].path) :] if n.scope else n.path


def element_at(top: Element, path: tuple[str, ...]) -> Element:
    for step in path:
        if not step.startswith(("@", "$")):
            top = top.children[step]
    return top


def read_scalar(n: Node, spoke: Spoke, base: Column, top: Element, index: Column | None) -> tuple[Column, list[X.Told]]:
    """The value and its possible diagnostics, in the order in which they are told."""
    key, path = n.canonical_key or n.clone_of, n.source_path
    tell = lambda when, severity, code, message, p=None, chain=None: X.diagnostic(when, severity, code, n.id, key, p, message, index, chain)
    out: list[X.Told] = []
    if n.multiple:
        every = F.transform(leaf(base, top, below(spoke, n), True), lambda v: X.normalise(v, n.normalize))
        items = F.coalesce(F.filter(every, lambda v: v.isNotNull()), F.array().cast("array<string>"))
        count = F.size(items)
        if n.multiple == "join":
            raw = F.when(count > 0, F.array_join(items, n.join_with or ""))
        elif n.multiple == "first":
            raw = F.get(items, F.lit(0))
            out.append(tell(count > 1, "warning", "MULTIPLE_VALUES", F.concat(F.lit("using the first of "), count, F.lit(f" values for `{key}`")), path))
        else:
            raw = F.when(count == 1, F.get(items, F.lit(0)))
            out.append(tell(count > 1, "error", "MULTIPLE_VALUES", F.concat(F.lit("found "), count, F.lit(f" values for single-valued `{key}`")), path))
    else:
        raw = X.normalise(leaf(base, top, below(spoke, n)), n.normalize)
    for f in n.fallbacks:
        other = spoke.nodes[f]
        before = raw
        value = X.normalise(leaf(base, top, below(spoke, other)), other.normalize)
        out.append(tell(before.isNull() & value.isNotNull(), "info", "FALLBACK_USED", f"used fallback `{f}` for `{key}`", other.source_path, n.fallbacks))
        raw = F.coalesce(before, value)
    if n.required:
        out.append(tell(raw.isNull(), "error", "REQUIRED_MISSING", "required value is missing", path))
    if n.adapter:
        given, adapter = raw, X.ADAPTERS[n.adapter]
        raw = adapter.apply(given)
        if adapter.failure is not None:
            why = adapter.failure(given)
            out.append(tell(given.isNotNull() & why.isNotNull(), "error", "ADAPTER_FAILED", F.concat(F.lit(f"adapter `{n.adapter}` failed: "), why)))
            raw = F.when(why.isNull(), raw)
    if n.type in X.SHAPES:
        out.append(tell(raw.isNotNull() & ~X.valid(raw, n.type), "error", "TYPE_INVALID", F.concat(F.lit("`"), raw, F.lit(f"` is not a valid {X.SPOKEN[n.type]}"))))
    return X.decode(raw, n.type), out


def keyed_scalars(spoke: Spoke, scope: str | None) -> list[Node]:
    return [n for n in spoke.inside(scope) if n.type != "collection" and n.canonical_key and not n.clone_of]


def keyed_collections(spoke: Spoke, scope: str | None) -> list[Node]:
    return [n for n in spoke.inside(scope) if n.type == "collection" and n.canonical_key]


# The record of a scope, its diagnostics, and whether an element is repeated that must not be, are made apart from each
# other, so that a plan computes only those that are asked for.


def read_values(spoke: Spoke, scope: str | None, base: Column, top: Element, wanted: set[str] | None = None) -> dict[str, Column]:
    """The fields of one scope by name. wanted: the ids of nodes whose values are asked for, else all."""
    asked = lambda n: wanted is None or n.id in wanted
    fields = {snake(n.canonical_key): read_scalar(n, spoke, base, top, None)[0] for n in keyed_scalars(spoke, scope) if asked(n)}
    for n in keyed_collections(spoke, scope):
        if asked(n):
            raw, inner = elements(spoke, n, base, top)
            fields[snake(n.canonical_key)] = F.transform(raw, _one(lambda e, n=n, inner=inner: as_struct(read_values(spoke, n.id, e, inner, wanted))))
    return fields


def as_struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def read_notes(spoke: Spoke, scope: str | None, base: Column, top: Element, index: Column | None) -> Column:
    """The diagnostics of one scope: of scalars, of copies, then of collections."""
    told: list[X.Told] = []
    values: dict[str, Column] = {}
    for n in keyed_scalars(spoke, scope):
        values[n.canonical_key], entries = read_scalar(n, spoke, base, top, index)
        told += entries
    for n in spoke.inside(scope):
        if n.clone_of:
            copy, entries = read_scalar(n, spoke, base, top, index)
            message = F.concat(F.lit("copy value `"), X.render(copy, n.type), F.lit(f"` does not match the canonical `{n.clone_of}` value"))
            same = copy.eqNullSafe(values[n.clone_of])
            if n.type == "decimal":
                same = copy.cast("decimal(38,18)").eqNullSafe(values[n.clone_of].cast("decimal(38,18)"))
            told += [*entries, X.diagnostic(copy.isNotNull() & ~same, "warning", "CLONE_MISMATCH", n.id, n.clone_of, n.source_path, message, index)]
    parts = [X.diagnostics(told)]
    for n in keyed_collections(spoke, scope):
        raw, inner = elements(spoke, n, base, top)
        if n.least:
            message = F.concat(F.lit(f"collection `{n.canonical_key}` has "), F.size(raw), F.lit(f" items, expected at least {n.least}"))
            parts.append(X.diagnostics([X.diagnostic(F.size(raw) < n.least, "error", "MIN_ITEMS", n.id, n.canonical_key, n.source_path, message)]))
        if speaks(spoke, n.id):
            parts.append(F.flatten(F.transform(raw, _two(lambda e, i, n=n, inner=inner: read_notes(spoke, n.id, e, inner, i)))))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def speaks(spoke: Spoke, scope: str) -> bool:
    """Whether reading the items of a collection can tell a diagnostic at all."""
    told = lambda n: n.clone_of or n.required or n.fallbacks or n.adapter or n.least or n.multiple in ("first", "error") or n.type in X.SHAPES
    return any(told(n) or (n.type == "collection" and speaks(spoke, n.id)) for n in spoke.inside(scope) if n.canonical_key or n.clone_of)


def read_twice(spoke: Spoke, scope: str | None, base: Column, top: Element) -> list[Column]:
    """Whether each element that may stand only once is repeated, in this scope and in the items of its collections."""
    out = repeats(base, top)
    for n in keyed_collections(spoke, scope):
        raw, inner = elements(spoke, n, base, top)
        if single(inner):
            out.append(F.exists(raw, _one(lambda e, n=n, inner=inner: any_of(read_twice(spoke, n.id, e, inner)))))
    return out


def single(e: Element) -> bool:
    """Whether e holds an element, at any depth, that may stand only once."""
    return any(not c.many or single(c) for c in e.children.values())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _one(f):
    return lambda e: f(e)


def _two(f):
    return lambda e, i: f(e, i)


def elements(spoke: Spoke, n: Node, base: Column, top: Element) -> tuple[Column, Element]:
    """The array of a collection's elements, empty where there are none, and what an element holds."""
    steps, holder, at = below(spoke, n), base, top
    for step in steps[:-1]:
        holder, at = F.get(holder[step], F.lit(0)), at.children[step]
    inner = at.children[steps[-1]]
    return F.coalesce(holder[steps[-1]], F.array().cast(T.ArrayType(inner.schema()))), inner


def repeats(base: Column, top: Element) -> list[Column]:
    """Whether each element that may stand only once is repeated; collections look after their own items."""
    out = []
    for name, e in sorted(top.children.items()):
        if e.many:
            continue
        out.append(F.coalesce(F.size(base[name]) > 1, F.lit(False)))
        if e.children:
            out += repeats(F.get(base[name], F.lit(0)), e)
    return out


#: The parsed document, and what is said of it, beside the columns of docs.
PARSED, STATUS, NOTES, VALUE = (f"_ledgerloom_{x}" for x in ("parsed", "status", "notes", "value_"))


def parsed(docs: DataFrame, spoke: Spoke, xml: str = "xml", strict: bool = True, only: Column | None = None, to: str = PARSED, said: str = STATUS) -> tuple[DataFrame, Element]:
    """docs with `to`, a struct of the mapped elements, and their status; `only` holds for the rows that are parsed at all.

    The parse is a generator's output: filters on other columns pass below it, and those on the status stay above, so
    that a document is parsed once, however often the parse is asked for.
    """
    top = Element.of(spoke)
    schema = top.schema()
    assert isinstance(schema, T.StructType)
    schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    tree = F.from_xml(F.coalesce(F.col(quoted(xml)), F.lit("")), schema, OPTIONS)
    if only is not None:
        tree = F.when(only, tree)
    out = docs.select("*", F.explode_outer(F.array(tree)).alias(to))
    p = F.col(to)
    twice = any_of(read_twice(spoke, None, p, top)) if strict else F.lit(False)
    status = F.when(p.isNull() | p["_corrupt_record"].isNotNull(), "malformed").when(F.coalesce(twice, F.lit(False)), "repeated").otherwise("ok")
    return out.withColumn(said, status), top


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flat(docs: DataFrame, spoke: Spoke, xml: str = "xml", strict: bool = True, wanted: set[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs with STATUS, NOTES and a column VALUE + name for each field of the record; and the names."""
    out, top = parsed(docs, spoke, xml, strict)
    values = read_values(spoke, None, F.col(PARSED), top, wanted)
    ok = F.col(STATUS) == "ok"
    fields = [F.when(ok, c).alias(VALUE + name) for name, c in values.items()]
    notes = F.when(ok, read_notes(spoke, None, F.col(PARSED), top, None)).otherwise(X.diagnostics([])).alias(NOTES)
    return out.select(*[F.col(quoted(c)) for c in docs.columns], STATUS, notes, *fields), list(values)


def to_hub(docs: DataFrame, spoke: Spoke, xml: str = "xml", strict: bool = True) -> DataFrame:
    """docs with hub, diagnostics and status in place of the parsed text.

    status: ok; malformed where the text is no XML; repeated where an element stands twice against its mapping. The
    record is null unless ok. With strict=False the first of repeated elements is taken.
    """
    names = [F.col(quoted(c)) for c in docs.columns if c not in ("hub", "diagnostics", "status")]
    out, fields = flat(docs, spoke, xml, strict)
    hub = F.when(F.col(STATUS) == "ok", F.struct(*[F.col(VALUE + f).alias(f) for f in fields]))
    return out.select(*names, hub.alias("hub"), F.col(NOTES).alias("diagnostics"), F.col(STATUS).alias("status"))


def to_fields(docs: DataFrame, spoke: Spoke, keys: list[str] | None = None, xml: str = "xml", strict: bool = True) -> DataFrame:
    """docs with status, diagnostics and the record's fields as columns of their own: those of keys (labels as
    `InvoiceLines/LineId` choose parts of a collection), else all. What is not selected of them is not computed.

    The fields are null and the diagnostics empty unless the status is ok. Columns of docs go where a field has their name.
    """
    wanted = None if keys is None else spoke.chosen(keys)
    out, fields = flat(docs, spoke, xml, strict, wanted)
    kept = [F.col(quoted(c)) for c in docs.columns if c not in {"status", "diagnostics", *fields}]
    return out.select(*kept, F.col(STATUS).alias("status"), F.col(NOTES).alias("diagnostics"), *[F.col(VALUE + f).alias(f) for f in fields])


def to_items(docs: DataFrame, spoke: Spoke, collection: str, keys: list[str] | None = None, xml: str = "xml", strict: bool = True) -> DataFrame:
    """A row per element of a collection at the top of the documents that are ok: docs' columns, position from 0, and
    the item's fields. keys as in to_fields, below the collection."""
    node = next(n for n in spoke.inside(None) if n.type == "collection" and n.canonical_key == collection)
    wanted = None if keys is None else spoke.chosen([f"{collection}/{k}" for k in keys])
    out, top = parsed(docs, spoke, xml, strict)
    raw, inner = elements(spoke, node, F.col(PARSED), top)
    names = [F.col(quoted(c)) for c in docs.columns]
    rows = out.where(F.col(STATUS) == "ok").select(*names, F.posexplode_outer(raw).alias("_ledgerloom_at", "_ledgerloom_item")).where(F.col("_ledgerloom_at").isNotNull())
    fields = read_values(spoke, node.id, F.col("_ledgerloom_item"), inner, wanted)
    kept = [F.col(quoted(c)) for c in docs.columns if c not in {"position", *fields}]
    return rows.select(*kept, F.col("_ledgerloom_at").alias("position"), *[c.alias(name) for name, c in fields.items()])
