"""The element tree that a mapping implies, and the faults in it.

Elements of one name share one shape, wherever they stand, so two nodes can ask for one field in two ways: a text that is
a container elsewhere, an element that repeats here and not there. A node's place is looked up in the finished shapes
again, as a document's reader would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ledgerloom.functions.names import xml_snake


@dataclass(frozen=True)
class Field:
    """What a shape holds under a name: text, or elements of another shape."""

    xml: str
    shape: str | None = None
    repeated: bool = False
    optional: bool = True


Shapes = dict[str, dict[str, Field]]


def shape_name(element: str) -> str:
    """The name that elements share: their words in capitals, run together."""
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^0-9A-Za-z]+", element))


def placed(node_id: str, kind: str, xml: str | None, multiple: str | None, steps: list[str], inner: bool) -> tuple[list[tuple[str, Field]], str | None]:
    """The fields from the scope's shape down to a node, or why the node can't be placed. inner: other nodes stand below it."""
    way = [(xml_snake(s), Field(s, shape_name(s), optional=False)) for s in steps[:-1]]
    last, name = steps[-1], xml_snake(steps[-1])
    held = "an element with others inside" if inner else None
    if kind == "collection":
        held = "a collection"
    elif (xml or "").startswith("@"):
        held = "an attribute"
    elif xml == "$text":
        held = "element text"
    if multiple and held:
        return [], f"{held} can't be multiple"
    if kind == "collection":
        end = [(name, Field(xml or last, shape_name(last), repeated=True, optional=False))]
    elif xml == "$text":
        # the node names the text of the element around it
        end = [("value", Field("$text"))]
    elif held == "an element with others inside":
        end = [(name, Field(xml or last, shape_name(last), optional=False)), ("value", Field("$text"))]
    else:
        end = [(name, Field(xml or last, repeated=bool(multiple), optional=not multiple))]
    return way + end, None


def entered(shapes: Shapes, top: str, fields: list[tuple[str, Field]]) -> str | None:
    """Put fields into the shapes; the name of the one that is there in another way already, if any."""
    at = top
    for name, field in fields:
        own = shapes.setdefault(at, {})
        if own.get(name, field) != field:
            return f"{at}.{name}"
        own[name] = field
        at = field.shape or at
        if field.shape:
            shapes.setdefault(at, {})
    return None


def looked_up(shapes: Shapes, top: str, names: list[str]) -> tuple[Field | None, bool]:
    """The field at the end of a path, None if the path leads nowhere; and whether anything on it repeats."""
    at, field, repeated = top, None, False
    for k, name in enumerate(names):
        field = shapes.get(at, {}).get(name)
        if field is None or (field.shape is None and k < len(names) - 1):
            return None, repeated
        repeated |= field.repeated
        at = field.shape or at
    return field, repeated


def laid_out(root: str, nodes: list[tuple[str, str, str | None, str | None, str | None, list[str]]]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """For nodes given as (id, type, xml, multiple, scope, steps below the scope), in order of id: the path of each in its
    scope, and the faults as (code, node, message)."""
    shapes: Shapes = {root: {}}
    out: list[tuple[str, str, str]] = []
    paths: dict[str, list[str]] = {}
    ids = [n[0] for n in nodes]
    top = lambda scope: shape_name(scope.rpartition(".")[2]) if scope else root
    for node_id, kind, xml, multiple, scope, steps in nodes:
        if not steps:
            out.append(("E024", node_id, "no element path below its scope"))
            continue
        fields, why = placed(node_id, kind, xml, multiple, steps, any(i.startswith(node_id + ".") for i in ids))
        if why is None and (twice := entered(shapes, top(scope), fields)):
            why = f"{twice} is defined in two ways"
        if why:
            out.append(("E024", node_id, why))
        else:
            paths[node_id] = [name for name, _ in fields]
    for node_id, kind, _, _, scope, _ in nodes:
        if scope and scope not in paths:
            continue  # told of the collection already
        field, repeated = looked_up(shapes, top(scope), paths.get(node_id, []))
        if field is None:
            out.append(("E021", node_id, "its path leads nowhere"))
        elif kind == "collection" and not repeated:
            out.append(("E022", node_id, "the element does not repeat"))
        elif kind != "collection" and field.shape:
            out.append(("E023", node_id, "a container has no value of its own"))
    return {i: ".".join(names) for i, names in paths.items()}, out
