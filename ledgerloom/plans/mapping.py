"""Mapping files: loading, inheritance, checks, and the canonical model that all formats together define."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ledgerloom.functions.names import snake
from ledgerloom.functions.text import ADAPTERS, NORMALISERS
from ledgerloom.plans import shapes

HERE = Path(__file__).resolve().parents[1] / "mappings"
TYPES = ("string", "identifier", "date", "datetime", "decimal", "currency", "unit_code", "boolean", "collection")
TEXT, TEXTS, TRUTH, COUNT = "a text", "a list of texts", "true or false", "a number from 0"
#: What a file may say, and in which form.
NEEDED = ("doc_format", "format_version", "mapping_version", "canonical_model")
META = dict.fromkeys([*NEEDED, "root", "source_model", "inherits", "description"], TEXT) | {"detect": TEXTS, "disabled": TRUTH}
NODE = {
    "xml": TEXT, "type": TEXT, "canonical_key": TEXT, "required": TRUTH, "fallbacks": TEXTS, "description": TEXT, "min_items": COUNT, "multiple": TEXT, "join_with": TEXT,
    "normalize": TEXTS, "adapter": TEXT, "constant": TEXT, "clone_of": TEXT, "disabled": TRUTH,
}
WORDS = {"type": TYPES, "multiple": ("error", "first", "join"), "normalize": tuple(NORMALISERS)}
#: Literals that a constant may be, by type; other types take any text that is not blank.
LITERALS = {
    "decimal": r"[+-]?\d+(\.\d+)?",
    "date": r"\d{4}-\d{2}-\d{2}",
    "datetime": r"\d{4}-\d{2}-\d{2}T.+",
    "currency": r"[A-Z]{3}",
    "boolean": r"true|false",
    "unit_code": r"[0-9A-Za-z]{1,3}",
}


class MappingError(Exception):
    """A mapping set that can't be loaded at all."""


@dataclass(frozen=True)
class Finding:
    code: str
    node: str
    message: str
    severity: str = "error"


@dataclass
class Node:
    id: str
    type: str
    canonical_key: str | None = None
    xml: str | None = None
    required: bool = False
    fallbacks: list[str] = field(default_factory=list)
    min_items: int | None = None
    multiple: str | None = None
    join_with: str | None = None
    normalize: list[str] = field(default_factory=list)
    adapter: str | None = None
    constant: str | None = None
    clone_of: str | None = None
    description: str | None = None
    path: tuple[str, ...] = ()  # elements below the root, an attribute as "@name", element text as "$text"
    scope: str | None = None  # id of the nearest collection around it
    source_path: str = ""  # as diagnostics tell it

    @property
    def least(self) -> int:
        """How many items a collection must have."""
        return self.min_items if self.min_items is not None else int(self.required)


@dataclass
class Spoke:
    """One format: its identity and its nodes by id."""

    meta: dict
    nodes: dict[str, Node]

    @property
    def id(self) -> str:
        return f"{self.meta['doc_format']}:{self.meta['format_version']}"

    @property
    def root(self) -> str:
        return self.meta["root"]

    @property
    def markers(self) -> list[str]:
        return [m.lower() for m in self.meta.get("detect", [])]

    def inside(self, scope: str | None) -> list[Node]:
        return [n for _, n in sorted(self.nodes.items()) if n.scope == scope]

    def label(self, node: Node) -> str:
        """The key with the keys of the collections around it, outermost first."""
        keys, at = [node.canonical_key or ""], node.scope
        while at:
            keys.append(self.nodes[at].canonical_key or "")
            at = self.nodes[at].scope
        return "/".join(reversed(keys))

    def only(self, keys: set[str], required: bool = True) -> Spoke:
        """The same format with the nodes of these canonical keys and of what they need: the collections around them,
        fallbacks, and whatever is required, unless that is not asked for. Elements that are left out are not even parsed."""
        keep = {k for k, n in self.nodes.items() if n.canonical_key in keys or n.clone_of in keys or (required and (n.required or n.constant is not None))}
        while more := {x for k in keep for x in [self.nodes[k].scope, *self.nodes[k].fallbacks] if x} - keep:
            keep |= more
        return Spoke(self.meta, {k: n for k, n in self.nodes.items() if k in keep})

    def chosen(self, keys: list[str]) -> set[str]:
        """The ids of the nodes with these labels, and of the collections around them; a collection alone stands for all in it."""
        ids: set[str] = set()
        for k in keys:
            found = {n.id for n in self.keyed() if self.label(n) == k or self.label(n).startswith(k + "/")}
            if not found:
                raise KeyError(f"{self.id} has no {k}")
            ids |= found
        while more := {self.nodes[i].scope for i in ids if self.nodes[i].scope} - ids:
            ids |= more
        return ids

    def keyed(self) -> list[Node]:
        return [n for _, n in sorted(self.nodes.items()) if n.canonical_key and not n.clone_of]

    def covered(self) -> list[str]:
        return sorted({self.label(n) for n in self.keyed()})

    def required(self) -> list[str]:
        return sorted({self.label(n) for n in self.keyed() if n.required})


@dataclass
class Compiled:
    spokes: list[Spoke]
    fields: dict[str, str]  # label -> type, of the canonical model
    findings: list[Finding]

    def __getitem__(self, name: str) -> Spoke:
        return resolve_name(self.spokes, name)


def resolve_name(spokes: list[Spoke], name: str) -> Spoke:
    """By name:version or name alone, in any case; the first in order of id."""
    for s in sorted(spokes, key=lambda s: s.id):
        if name.lower() in (s.id.lower(), s.id.split(":")[0].lower()):
            return s
    raise KeyError(f"unknown format: {name}")


def has_form(value: object, form: str) -> bool:
    if form == TEXTS:
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    if form == COUNT:
        return isinstance(value, int) and not isinstance(value, bool) and value >= 0
    return isinstance(value, bool if form == TRUTH else str)


def strict(place: str, values: dict, forms: dict[str, str]) -> dict:
    """values, if every one has a known name, the form that it must have, and one of its words."""
    for name, value in values.items():
        if name not in forms:
            raise MappingError(f"E001: unknown field {name} in {place}")
        if not has_form(value, forms[name]):
            raise MappingError(f"E001: {name} in {place} must be {forms[name]}")
        for word in (value if isinstance(value, list) else [value]) if name in WORDS else []:
            if word not in WORDS[name]:
                raise MappingError(f"E001: {name} in {place} can't be {word}")
    return values


def flatten(table: dict) -> tuple[dict, dict[str, dict]]:
    """The meta table, and the nodes: tables with values of their own, by dotted id."""
    if "meta" not in table or not isinstance(table["meta"], dict):
        raise MappingError("E001: no [meta] table")
    meta = strict("[meta]", table["meta"], META)
    for name in NEEDED:
        if name not in meta:
            raise MappingError(f"E001: [meta] has no {name}")
    nodes: dict[str, dict] = {}

    def walk(prefix: str, value: dict) -> None:
        if own := {k: v for k, v in value.items() if not isinstance(v, dict)}:
            nodes[prefix] = strict(f"[{prefix}]", own, NODE)
        for k, v in value.items():
            if isinstance(v, dict):
                walk(f"{prefix}.{k}", v)

    for k, v in table.items():
        if k == "meta":
            continue
        if not isinstance(v, dict):
            raise MappingError(f"E001: a value outside of all tables: {k}")
        walk(k, v)
    return meta, nodes


def load(folder: Path | str = HERE) -> dict[str, tuple[dict, dict[str, dict]]]:
    """All mapping files of a folder, by id."""
    files = sorted(Path(folder).glob("*.toml"))
    if not files:
        raise MappingError(f"no mapping files in {folder}")
    return loaded([f.read_text(encoding="utf-8") for f in files])


def loaded(texts: list[str]) -> dict[str, tuple[dict, dict[str, dict]]]:
    out: dict[str, tuple[dict, dict[str, dict]]] = {}
    for text in texts:
        try:
            meta, nodes = flatten(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise MappingError(f"E001: not TOML: {e}") from e
        name = f"{meta['doc_format']}:{meta['format_version']}"
        if name in out:
            raise MappingError(f"{name} is defined twice")
        out[name] = meta, nodes
    return out


def chain(raw: dict, name: str) -> list[str]:
    """name and what it inherits from, the furthest first."""
    seen: list[str] = []
    at: str | None = name
    while at:
        if at in seen:
            raise MappingError(f"inheritance turns in a circle at {at}")
        if at not in raw:
            raise MappingError(f"unknown parent: {at}")
        seen.append(at)
        at = raw[at][0].get("inherits")
    return seen[::-1]


def assemble(raw: dict, name: str, found: list[Finding]) -> Spoke:
    merged: dict[str, dict] = {}
    meta: dict = {}
    for part in chain(raw, name):
        merged |= raw[part][1]  # whole nodes are replaced
        meta = {**raw[part][0]} if part == name else meta
    meta.setdefault("root", raw[chain(raw, name)[0]][0].get("root"))
    off = [k for k, v in merged.items() if v.get("disabled")]
    merged = {k: v for k, v in merged.items() if not any(k == o or k.startswith(o + ".") for o in off)}
    root, nodes = meta.get("root") or "Root", {}
    for k in sorted(merged):
        v = {a: b for a, b in merged[k].items() if a != "disabled"}
        if "type" not in v:
            found.append(Finding("E002", k, "a node needs a type"))
            continue
        parts = k.split(".")
        parts = parts[1:] if parts[0] == root else parts
        # the last part of an id names an attribute or the element's text, where xml says so, or is renamed
        nodes[k] = Node(id=k, path=tuple([*parts[:-1], v["xml"]] if parts and v.get("xml") else parts), **v)
    for k, n in nodes.items():
        around = [c for c in nodes if nodes[c].type == "collection" and k.startswith(c + ".")]
        n.scope = max(around, key=len, default=None)
    parts_of = lambda n: n.id.split(".")[len(n.scope.split(".")) if n.scope else int(n.id.split(".")[0] == root) :]
    paths, told = shapes.laid_out(root, [(n.id, n.type, n.xml, n.multiple, n.scope, parts_of(n)) for n in nodes.values()])
    found += [Finding(*x) for x in told]
    for k, n in nodes.items():
        n.source_path = paths.get(k, "")
    return Spoke({**meta, "root": root}, nodes)


def check(spoke: Spoke) -> list[Finding]:
    """The rules that one format must keep by itself."""
    out: list[Finding] = []
    nodes = spoke.nodes
    say = lambda code, n, text: out.append(Finding(code, n.id, text))
    keys: dict[tuple, str] = {}
    for n in nodes.values():
        scalar = n.type != "collection"
        if n.canonical_key and not n.clone_of:
            if (n.scope, n.canonical_key) in keys:
                say("E013", n, f"{n.canonical_key} is mapped by {keys[n.scope, n.canonical_key]} too")
            keys[n.scope, n.canonical_key] = n.id
            if n.scope and not nodes[n.scope].canonical_key:
                say("E011", n, "the collection around it has no key")
        if (n.multiple == "join") != (n.join_with is not None):
            say("E040", n, "join and join_with go together")
        if n.min_items is not None and scalar:
            say("E041", n, "min_items is for collections")
        if n.multiple and n.fallbacks:
            say("E043", n, "multiple and fallbacks exclude each other")
        if n.adapter and n.adapter not in ADAPTERS:
            say("E050", n, f"unknown adapter {n.adapter}")
        for f in n.fallbacks:
            if f not in nodes:
                say("E030", n, f"no such fallback: {f}")
            elif nodes[f].type != n.type and not {nodes[f].type, n.type} <= {"string", "identifier"}:
                say("E031", n, f"{f} has another type")
            elif nodes[f].scope != n.scope:
                say("E032", n, f"{f} is in another scope")
        if n.constant is not None:
            if not scalar:
                say("E060", n, "a collection can't be constant")
            elif not n.constant.strip() or (n.type in LITERALS and not re.fullmatch(LITERALS[n.type], n.constant)):
                say("E061", n, f"not a literal of type {n.type}")
            if n.fallbacks or n.multiple or n.adapter or n.normalize:
                say("E062", n, "a constant stands alone")
    for n in nodes.values():
        if n.clone_of:
            if n.type == "collection" or n.canonical_key or n.constant is not None or n.fallbacks:
                say("E070", n, "a copy has no other role")
            elif (n.scope, n.clone_of) not in keys:
                say("E071", n, f"no key {n.clone_of} in its scope")
            elif nodes[keys[n.scope, n.clone_of]].type != n.type:
                say("E072", n, f"another type than {n.clone_of}")
        seen, stack = set(), list(n.fallbacks)
        while stack:
            at = stack.pop()
            if at == n.id:
                say("E033", n, "fallbacks turn in a circle")
                break
            if at in nodes and at not in seen:
                seen.add(at)
                stack += nodes[at].fallbacks
    return out


def derive(spokes: list[Spoke], found: list[Finding]) -> dict[str, str]:
    """The canonical model: the union of all labels; the first format in order of id decides on a type."""
    fields: dict[str, str] = {}
    scopes: dict[str, str] = {}
    names: dict[tuple[str, str], str] = {}
    for s in spokes:
        for n in s.keyed():
            label = s.label(n)
            around = label.rpartition("/")[0]
            if fields.setdefault(label, n.type) != n.type:
                found.append(Finding("E010", f"{s.id}::{n.id}", f"{label} is {fields[label]} elsewhere"))
            if n.type == "collection" and scopes.setdefault(n.canonical_key, around) != around:
                found.append(Finding("E012", f"{s.id}::{n.id}", f"{n.canonical_key} is in two scopes"))
            if names.setdefault((around, snake(n.canonical_key)), n.canonical_key) != n.canonical_key:
                found.append(Finding("E012", f"{s.id}::{n.id}", f"{n.canonical_key} has another key's column name"))
    return fields


def compile_all(folder: Path | str = HERE) -> Compiled:
    """Every enabled format of a folder, checked; all findings are gathered, none stops the rest."""
    return compiled(load(folder))


def compiled(raw: dict[str, tuple[dict, dict[str, dict]]]) -> Compiled:
    found: list[Finding] = []
    spokes = []
    for name in sorted(raw):
        if raw[name][0].get("disabled"):
            continue
        own: list[Finding] = []
        s = assemble(raw, name, own)
        model = s.meta.get("source_model")
        if model and model != s.id:
            own.append(Finding("E020", s.id, f"{model} is not the model of this file"))
        found += [Finding(f.code, f"{name}::{f.node}", f.message) for f in own + check(s)]
        spokes.append(s)
    fields = derive(spokes, found)
    return Compiled(spokes, fields, found)
