"""Fallbacks, copies, constants, adapters and repeated values, read and written by small mappings of their own."""

import pytest

from ledgerloom.engine import Engine
from ledgerloom.operators import analysis
from ledgerloom.plans import mapping as m

META = '[meta]\ndoc_format="{}"\nformat_version="1"\nmapping_version="1"\ncanonical_model="c"\nroot="{}"\n'
RICH = """
[R.A]
type="string"
canonical_key="Name"
fallbacks=["R.B", "R.C"]
[R.B]
type="string"
normalize=["trim", "empty_as_missing"]
[R.C]
type="string"
[R.Amount]
type="decimal"
canonical_key="Amount"
[R.Amount.Currency]
xml="@cur"
type="currency"
canonical_key="Currency"
adapter="uppercase_currency"
[R.Copy]
type="decimal"
clone_of="Amount"
[R.Kind]
type="string"
constant="380"
[R.First]
type="string"
canonical_key="First"
multiple="first"
[R.Single]
type="string"
canonical_key="Single"
multiple="error"
normalize=["trim", "empty_as_missing"]
[R.Flag]
type="boolean"
canonical_key="Flag"
[R.L]
type="collection"
canonical_key="Lines"
[R.L.X]
type="string"
canonical_key="X"
required=true
[R.L.K]
type="string"
constant="k"
[R.L.S]
type="collection"
canonical_key="Subs"
min_items=1
[R.L.S.Y]
type="date"
canonical_key="Y"
"""
XML = """<p:R xmlns:p="urn:p"><B> </B><C>third</C><Amount cur="eur">1.50</Amount><Copy>1.5</Copy><First>a</First><First>b</First>
<Single> </Single><Single>s</Single><Flag>true</Flag><L><X>x</X><S><Y>2024-01-01</Y></S><S><Y>no</Y></S></L><L/></p:R>"""


@pytest.fixture(scope="module")
def engine(tmp_path_factory):
    folder = tmp_path_factory.mktemp("mappings")
    (folder / "rich.toml").write_text(META.format("rich", "R") + RICH)
    (folder / "poor.toml").write_text(META.format("poor", "P") + '[P.Other]\ntype="string"\ncanonical_key="Other"\nrequired=true\n')
    out = Engine(folder)
    assert out.compiled.findings == []
    return out


def test_read(spark, engine):
    r = engine.to_hub(spark.createDataFrame([(XML,)], "xml string"), "rich").first()
    h = r.hub
    assert r.status == "ok" and (h.name, h.amount, h.currency, h.first, h.single, h.flag) == ("third", "1.50", "EUR", "a", "s", True)
    assert [[s.y for s in x.subs] for x in h.lines] == [["2024-01-01", None], []]
    got = [(d.severity, d.code, d.canonical_key, d.collection_index) for d in r.diagnostics]
    assert got == [
        ("info", "FALLBACK_USED", "Name", None), ("warning", "MULTIPLE_VALUES", "First", None), ("error", "TYPE_INVALID", "Y", 1),
        ("error", "REQUIRED_MISSING", "X", 1), ("error", "MIN_ITEMS", "Subs", None),
    ]
    assert list(r.diagnostics[0].fallback_chain) == ["R.B", "R.C"] and r.diagnostics[0].source_path == "c"


def test_copies_that_differ_and_values_that_repeat(spark, engine):
    xml = XML.replace("<Copy>1.5<", "<Copy>2<").replace("<Single> <", "<Single>t<")
    r = engine.to_hub(spark.createDataFrame([(xml,)], "xml string"), "rich").first()
    said = {d.code: d.message for d in r.diagnostics if d.severity != "info"}
    assert said["CLONE_MISMATCH"] == "copy value `2` does not match the canonical `Amount` value"
    assert "found 2 values for single-valued `Single`" in {d.message for d in r.diagnostics} and r.hub.single is None


def test_write(spark, engine):
    xml = engine.transform(spark.createDataFrame([(XML,)], "xml string"), "rich", "rich").first().xml_out
    for part in ("<A>third</A>", '<Amount cur="EUR">1.50</Amount>', "<Copy>1.50</Copy>", "<Kind>380</Kind>", "<K>k</K>"):
        assert xml.count(part) == 1, part
    assert "<B>" not in xml and xml.count("<L>") == 1


def test_error_state_and_detail(spark, engine):
    rows = {(r.source, r.target): (r.state, r.detail) for r in analysis.conversions(spark, engine.compiled).collect()}
    assert rows["rich:1", "poor:1"] == ("error", "missing required Other")
    # nothing at top level is required: Lines/X is, and poor has none of what rich requires
    assert rows["poor:1", "rich:1"][0] == "error" and rows["rich:1", "rich:1"] == ("lossless", "—")


def test_replies(spark, engine):
    rows = [(0, "<R><A>a</A></R>"), (1, "<P/>"), (2, "<html/>"), (3, "<R><A>"), (4, "<R><C>c</C></R>"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, xml string")
    got = {r.doc_id: r for r in engine.replies(df, "rich").collect()}
    assert {k: r.http_status for k, r in got.items()} == {0: 200, 1: 422, 2: 400, 3: 400, 4: 200, 5: 400}
    assert got[0].body.strip() == "<R><A>a</A><Kind>380</Kind></R>" and got[0].warnings == "" and "FALLBACK_USED" in got[4].warnings
    assert got[1].body == "transformation failed with errors:\nerror [REQUIRED_MISSING] P.Other: required value is missing"
    one = engine.replies(df.where("doc_id = 3"), "rich", "rich").first()
    assert one.http_status == 400 and one.body.endswith("malformed")


def test_spokes_of_one_key_in_two_types(tmp_path):
    for name, kind in (("a", "string"), ("b", "date")):
        (tmp_path / f"{name}.toml").write_text(META.format(name, "R") + f'[R.A]\ntype="{kind}"\ncanonical_key="A"\n')
    assert {f.code for f in m.compile_all(tmp_path).findings} == {"E010"}
