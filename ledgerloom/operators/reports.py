"""The static reports as text, for people: made from collected rows of the analysis, whose size the mappings fix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ledgerloom.operators import analysis
from ledgerloom.plans.mapping import Compiled

#: The verdicts and one sign for each.
SIGNS = {"lossless": "=", "lossful": "~", "partial": "!", "error": "x"}
#: What the verdicts mean here.
MEANING = {
    "lossless": "the target has every field of the source",
    "lossful": "the target lacks some",
    "partial": "some that the target must have are not in the source",
    "error": "none of them is",
}


def table(rows: list[list[str]]) -> str:
    """Rows of cells, parted by bars that stand below each other."""
    wide = [max(len(r[k]) for r in rows) for k in range(len(rows[0]) - 1)]
    return "\n".join(" | ".join([*(cell.ljust(w) for cell, w in zip(r, wide, strict=False)), r[-1]]) for r in rows) + "\n"


def conversion_table(spark: SparkSession, c: Compiled, source: str | None = None) -> str:
    """What each conversion loses, of all formats or of one."""
    chosen = c[source].id if source else None
    rows = [[r["source"], r["target"], SIGNS[r["state"]], r["detail"]] for r in sorted(analysis.conversions(spark, c).collect()) if chosen in (None, r["source"])]
    return table([["from", "to", "?", "lost"], *rows]) + "\n" + "".join(f"{SIGNS[k]} {k}: {v}\n" for k, v in MEANING.items())


def key_table(spark: SparkSession, c: Compiled) -> str:
    """Every canonical key with the formats that have it, in brackets those that must have it."""
    rows = []
    for r in sorted(analysis.keys(spark, c).collect()):
        needed = set(r["required_by"].split(","))
        names = r["defined_by"].split(",")
        rows.append([r["field"], f"{len(names)} of {len(c.spokes)}", " ".join(f"[{n}]" if n in needed else n for n in names)])
    return table([["key", "formats", "names, [in brackets] where it is required"], *rows])


def spoke_key_text(spark: SparkSession, c: Compiled, name: str) -> str:
    """The canonical keys that one format has, and those that only others have."""
    spoke = c[name]
    others = {r["field"]: r["defined_by"].replace(",", " ") for r in analysis.keys(spark, c).collect()}
    needed = set(spoke.required())
    rows = []
    for r in analysis.spoke_keys(spark, c, name).collect():
        k = r["field"]
        rows.append(["+", k, "required" if k in needed else ""] if r["covered"] else ["-", k, others[k]])
    rows.sort(key=lambda r: (r[0] == "-", r[1]))
    has = sum(r[0] == "+" for r in rows)
    return f"{spoke.id}: {has} keys (+), {len(rows) - has} that other formats have (-)\n" + table(rows)


def check_text(c: Compiled) -> str:
    """All findings, and how many there are."""
    told = "".join(f"{f.code} {f.severity} at {f.node}: {f.message}\n" for f in c.findings)
    errors = sum(f.severity == "error" for f in c.findings)
    return f"{told}formats: {len(c.spokes)}, fields: {len(c.fields)}, errors: {errors}, other findings: {len(c.findings) - errors}\n"


def coverage_markdown(c: Compiled) -> str:
    """The coverage as a table in Markdown, then the gaps by format."""

    def row(cells: Iterable[str]) -> str:
        return "| " + " | ".join(cells) + " |\n"

    has = {s.id: set(s.covered()) for s in c.spokes}
    lines = row(["field", *has]) + "|" + "-|" * (len(has) + 1) + "\n" + "".join(row([f, *("✓" if f in own else "·" for own in has.values())]) for f in sorted(c.fields))
    gaps = [f"* {s}: " + ", ".join(f"`{f}`" for f in sorted(c.fields) if f not in own) for s, own in sorted(has.items()) if len(own) < len(c.fields)]
    return f"# Fields by format\n\n{lines}\n# Fields that a format lacks\n\n" + "".join(g + "\n" for g in gaps)
