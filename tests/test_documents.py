"""Documents through the engine: typed reading, faults, writing, detection, analysis."""

import pytest

from ledgerloom.engine import Engine
from ledgerloom.functions import text as X
from ledgerloom.operators import analysis

LINE = "<InvoiceLine><ID>1</ID><InvoicedQuantity>2.50</InvoicedQuantity><Item><Name>Pen</Name></Item></InvoiceLine>"
HEAD = "<ID> A1 </ID><IssueDate>2024-02-30</IssueDate><Note>one</Note><Note> two </Note><DocumentCurrencyCode>eur</DocumentCurrencyCode>"
TOTAL = '<LegalMonetaryTotal><PayableAmount currencyID="EUR">119.00</PayableAmount></LegalMonetaryTotal>'
GOOD = f"<Invoice>{HEAD}{TOTAL}{LINE}</Invoice>"
KEYS = {"InvoiceNumber", "IssueDate", "InvoiceNote", "DocumentCurrency", "PayableAmount", "PayableAmountCurrency", "LineId", "Quantity", "ItemName", "SpecificationId"}


@pytest.fixture(scope="module")
def engine():
    return Engine(keys=KEYS)


def read(spark, engine, *xml):
    return engine.to_hub(spark.createDataFrame(list(enumerate(xml)), "doc_id long, xml string"), "ubl-invoice").orderBy("doc_id").collect()


def test_typed_read_and_faults(spark, engine):
    good, empty, twice, torn, none = read(spark, engine, GOOD, "<Invoice><ID></ID></Invoice>", GOOD.replace("<IssueDate>", "<IssueDate>x</IssueDate><IssueDate>"), "no <<<", None)
    h = good.hub
    assert (h.invoice_number, h.issue_date, h.document_currency, h.payable_amount, h.payable_amount_currency) == ("A1", "2024-02-30", "EUR", "119.00", "EUR")
    assert h.invoice_note == "one\ntwo" and h.invoice_lines[0].item_name == "Pen" and good.diagnostics == []
    assert [(d.code, d.source_node) for d in empty.diagnostics] == [("REQUIRED_MISSING", "Invoice.ID"), ("MIN_ITEMS", "InvoiceLine")]
    assert [twice.status, torn.status, none.status] == ["repeated", "malformed", "malformed"]
    assert twice.hub is None


def test_target_asks_for_more_and_gate(spark, engine):
    df = spark.createDataFrame([(1, GOOD)], "doc_id long, xml string")
    r = engine.transform(df, "ubl-invoice", "xrechnung-invoice").first()
    assert not r.accepted and [(d.code, d.canonical_key) for d in r.diagnostics] == [("REQUIRED_MISSING", "SpecificationId")]
    assert engine.transform(df, "ubl-invoice", "facturx-invoice").first().accepted
    assert "Supplier" not in r.xml_out


def test_detection(spark, engine):
    mark = "<Invoice><CustomizationID>urn:XRechnung</CustomizationID></Invoice>"
    note = "<Invoice><Note>xrechnung</Note></Invoice>"
    rows = [(0, mark), (1, note), (2, "<a:FatturaElettronica/>"), (3, "<html></html>"), (4, None), (5, "")]
    got = engine.detect(spark.createDataFrame(rows, "doc_id long, xml string")).orderBy("doc_id").collect()
    assert [r.spoke for r in got] == ["xrechnung-invoice:3.0.2", "ubl-invoice:2.1", "fatturapa:1.2.2", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(
    ("inside", "spoke"),
    [
        ("<!-- <CustomizationID>urn:xrechnung</CustomizationID> -->", "ubl-invoice:2.1"),
        ("<Note><![CDATA[<CustomizationID>peppol</CustomizationID>]]></Note>", "ubl-invoice:2.1"),
        ("<CustomizationID><![CDATA[peppol]]></CustomizationID>", "ubl-invoice:2.1"),
        ("<?x <CustomizationID>peppol</CustomizationID>?>", "ubl-invoice:2.1"),
        ("<CustomizationID><!-- of the network -->urn:peppol</CustomizationID>", "peppol-bis-billing:3.0"),
        ("<CustomizationID>urn<!-- -->peppol</CustomizationID>", "ubl-invoice:2.1"),
        ("<CustomizationID/><Note>peppol</Note>", "ubl-invoice:2.1"),
        ("<CustomizationID a='b'/><Note>peppol</Note>", "ubl-invoice:2.1"),
        ("<CustomizationID> </CustomizationID><x:CustomizationID a='b'> PEPPOL </x:CustomizationID>", "peppol-bis-billing:3.0"),
        ("<Deep><CustomizationID>a xrechnung b</CustomizationID></Deep>", "xrechnung-invoice:3.0.2"),
    ],
)
def test_detection_reads_texts_of_elements_only(spark, engine, inside, spoke):
    df = spark.createDataFrame([(f"<?xml version='1.0'?><!-- <FatturaElettronica> --><Invoice>{inside}<ID>1</ID></Invoice>",)], "xml string")
    assert engine.detect(df).first().spoke == spoke


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("currency", ["EUR", " EUR "], ["eur", "EURO", "EU", ""]),
        ("unit_code", ["C62", "h"], ["", "ABCD", "a-b"]),
        ("date", ["2024-02-30", "2024-12-31"], ["2024-13-01", "2024-1-01", "2024/01/01", "2024-01-01\nx"]),
        ("datetime", ["2024-01-01T00:00:00Z", "2024-01-01T10:11:12.5+01:00"], ["2024-01-01T24:00:00", "2024-01-01"]),
        ("decimal", ["1", "-1.50", "+.5", "5."], ["1e3", "1,5", "", "."]),
        ("boolean", ["true", " false "], ["t", "1", "TRUE"]),
    ],
)
def test_shapes(spark, kind, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(X.valid(df.v, kind)).collect()] == [True] * len(good) + [False] * len(bad)


def test_conversions(spark):
    rows = {(r.source.split(":")[0], r.target.split(":")[0]): (r.state, r.n_missing, r.n_dropped) for r in analysis.conversions(spark, Engine().compiled).collect()}
    assert len(rows) == 25
    assert rows["fatturapa", "xrechnung-invoice"] == ("partial", 1, 0)
    assert rows["ubl-invoice", "facturx-invoice"] == ("lossful", 0, 2)


def test_columns_of_documents_stay_whatever_their_names(spark, engine):
    names = ["doc_id", "xml", "_parsed", "status", "invoice_number", "position", "hub", "a.b"]
    df = spark.createDataFrame([(1, GOOD, 2, 3, 4, 5, 6, 7)], " long, ".join(f"`{n}`" for n in names).replace("`xml` long", "xml string") + " long")
    r = engine.to_hub(df, "ubl-invoice").first()
    assert r["_parsed"] == 2 and r["invoice_number"] == 4 and r["a.b"] == 7 and r.hub.invoice_number == "A1" and r.status == "ok"
    r = engine.fields(df, "ubl-invoice", ["InvoiceNumber"]).first()
    assert r.invoice_number == "A1" and r.hub == 6 and r["a.b"] == 7
    r = engine.items(df, "ubl-invoice", "InvoiceLines", ["LineId"]).first()
    assert r.position == 0 and r.line_id == "1" and r["a.b"] == 7
    r = engine.transform(df, "ubl-invoice", "ubl-invoice").first()
    assert r["a.b"] == 7 and r["_parsed"] == 2 and r.accepted
    assert engine.transform_mixed(df, "ubl-invoice").first().accepted
    none = df.limit(0)
    assert engine.transform_mixed(none, "ubl-invoice").collect() == [] == engine.to_hub(none, "ubl-invoice").collect()
