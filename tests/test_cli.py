"""The command line, with its exit codes, and the reports."""

import io

import pytest

from ledgerloom import cli
from ledgerloom.engine import Engine
from ledgerloom.plans.__main__ import run as plans
from ledgerloom.plans.mapping import HERE

KEYS = {"InvoiceNumber", "DocumentCurrency", "LineId", "ItemName", "SpecificationId"}
GOOD = b"<Invoice><ID>A1</ID><DocumentCurrencyCode>eur</DocumentCurrencyCode><InvoiceLine><ID>1</ID></InvoiceLine></Invoice>"


@pytest.fixture(scope="module")
def call(spark):
    engines = {False: Engine(), True: Engine(keys=KEYS)}

    def of(*args: str, stdin: bytes = b"", few: bool = False):
        out, err = io.StringIO(), io.StringIO()
        return cli.run(list(args), io.BytesIO(stdin), out, err, lambda: spark, engines[few]), out.getvalue(), err.getvalue()

    return of


@pytest.mark.parametrize("args", [["a"], ["a", "b", "c"], ["--from"], ["--what"], ["--analyze", "--keys"], ["--keys", "a", "b"], ["--keys", "nope"], ["-", "nope"], ["-", "ubl-invoice", "--from", "nope"]])
def test_wrong_arguments(call, args):
    code, out, err = call(*args)
    assert code == 64 and err and not out


def test_help_and_list(call):
    assert call()[1] == call("x", "--help")[1] and call("-h")[0] == 0
    names = ["facturx-invoice:1.0", "fatturapa:1.2.2", "peppol-bis-billing:3.0", "ubl-invoice:2.1", "xrechnung-invoice:3.0.2"]
    assert call("--list")[1].split() == names and call("-h")[1].split()[-5:] == names


def test_transform(call, tmp_path):
    code, out, err = call("-", "UBL-Invoice", stdin=GOOD, few=True)
    assert code == 0 and "<ID>A1</ID>" in out and "EUR" in out and out.endswith(">\n") and err == ""
    (tmp_path / "in.xml").write_bytes(GOOD)
    assert call(str(tmp_path / "in.xml"), "ubl-invoice", "--out", str(tmp_path / "out.xml"), few=True) == (0, "", "")
    assert (tmp_path / "out.xml").read_text() == out
    assert call("-", "ubl-invoice", "--out", str(tmp_path / "no" / "out.xml"), stdin=GOOD, few=True)[0] == 74
    assert call(str(tmp_path / "none.xml"), "ubl-invoice")[0] == 74


def test_faults_of_documents(call):
    code, _, err = call("-", "xrechnung-invoice", stdin=GOOD, few=True)
    assert code == 65 and "error [REQUIRED_MISSING] Invoice.CustomizationID" in err
    assert call("-", "ubl-invoice", stdin=b"\xff\xfe")[0] == 65
    assert call("-", "ubl-invoice", "--from", "ubl-invoice", stdin=b"<Invoice>", few=True)[0] == 65
    assert call("-", "ubl-invoice", stdin=b"<html/>", few=True)[0] == 64


def test_reports(call):
    code, out, _ = call("--analyze", "fatturapa")
    rows = [[x.strip() for x in line.split("|")] for line in out.split("\n\n")[0].split("\n")]
    assert code == 0 and len(rows) == 6 and rows[5] == ["fatturapa:1.2.2", "xrechnung-invoice:3.0.2", "!", "missing required SpecificationId"]
    assert len(call("--analyze")[1].split("\n\n")[0].splitlines()) == 26
    keys = {line.split("|")[0].strip(): line for line in call("--keys")[1].splitlines()[1:]}
    assert len(keys) == 150 and "[xrechnung-invoice:3.0.2]" in keys["SpecificationId"] and "[ubl" not in keys["SpecificationId"]
    lines = call("--keys", "--from", "fatturapa")[1].splitlines()
    assert sum(x.startswith("+ |") for x in lines) == 11 and sum(x.startswith("- |") for x in lines) == 139
    assert [x.split("|")[1].strip() for x in lines if x.endswith("required")] == ["InvoiceLines", "InvoiceNumber"]


def test_mapping_commands(tmp_path):
    text, code = plans(["check", str(HERE)])
    assert code == 0 and "formats: 5" in text and "fields: 150" in text and "errors: 0" in text
    text, code = plans(["report", str(HERE)])
    assert code == 0 and "| InvoiceNumber | ✓ | ✓ | ✓ | ✓ | ✓ |" in text and "* facturx-invoice:1.0: `TaxPointDate`" in text
    (tmp_path / "a.toml").write_text('[meta]\ndoc_format="a"\nformat_version="1"\nmapping_version="1"\ncanonical_model="c"\nroot="R"\n[R.A]\ncanonical_key="A"\n')
    assert plans(["check", str(tmp_path)])[1] == 1 and plans(["report", str(tmp_path)])[1] == 0
    assert [plans(a)[1] for a in ([], ["what"], ["check"], ["check", str(tmp_path / "none")])] == [2, 2, 2, 2]
