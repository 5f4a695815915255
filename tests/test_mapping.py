"""The mapping compiler: its checks, inheritance, and the set of bundled mappings. No Spark."""

import pytest

from ledgerloom.functions import names
from ledgerloom.plans import mapping as m
from ledgerloom.plans import shapes

META = '[meta]\ndoc_format="f"\nformat_version="1"\nmapping_version="1"\ncanonical_model="c"\nroot="R"\n'


def codes(tmp_path, body: str, meta: str = META) -> set[str]:
    (tmp_path / "a.toml").write_text(meta + body)
    return {f.code for f in m.compile_all(tmp_path).findings}


@pytest.mark.parametrize(
    ("code", "body"),
    [
        ("E002", '[R.A]\ncanonical_key="A"'),
        ("E011", '[R.L]\ntype="collection"\n[R.L.A]\ntype="string"\ncanonical_key="A"'),
        ("E013", '[R.A]\ntype="string"\ncanonical_key="A"\n[R.B]\ntype="string"\ncanonical_key="A"'),
        ("E030", '[R.A]\ntype="string"\ncanonical_key="A"\nfallbacks=["R.X"]'),
        ("E031", '[R.A]\ntype="date"\ncanonical_key="A"\nfallbacks=["R.B"]\n[R.B]\ntype="string"'),
        ("E033", '[R.A]\ntype="string"\ncanonical_key="A"\nfallbacks=["R.B"]\n[R.B]\ntype="string"\nfallbacks=["R.A"]'),
        ("E040", '[R.A]\ntype="string"\ncanonical_key="A"\nmultiple="join"'),
        ("E041", '[R.A]\ntype="string"\ncanonical_key="A"\nmin_items=1'),
        ("E043", '[R.A]\ntype="string"\ncanonical_key="A"\nmultiple="first"\nfallbacks=["R.B"]\n[R.B]\ntype="string"'),
        ("E050", '[R.A]\ntype="string"\ncanonical_key="A"\nadapter="nope"'),
        ("E060", '[R.A]\ntype="collection"\ncanonical_key="A"\nconstant="x"'),
        ("E061", '[R.A]\ntype="decimal"\ncanonical_key="A"\nconstant="1."'),
        ("E062", '[R.A]\ntype="string"\ncanonical_key="A"\nconstant="x"\nnormalize=["trim"]'),
        ("E071", '[R.A]\ntype="string"\nclone_of="B"'),
        ("E020", ""),
        ("E024", '[R]\ntype="string"'),
        ("E021", '[R]\ntype="string"'),
        ("E024", '[R.A.X]\ntype="string"\n[R.B.A.X.Y]\ntype="string"'),
        ("E024", '[R.A]\ntype="collection"\ncanonical_key="A"\nmultiple="first"'),
        ("E024", '[R.A]\ntype="string"\nxml="@a"\nmultiple="first"'),
        ("E024", '[R.A.T]\ntype="string"\nxml="$text"\nmultiple="first"'),
        ("E024", '[R.A]\ntype="string"\nmultiple="first"\n[R.A.B]\ntype="string"'),
        ("E032", '[R.A]\ntype="string"\ncanonical_key="A"\nfallbacks=["R.L.B"]\n[R.L]\ntype="collection"\ncanonical_key="L"\n[R.L.B]\ntype="string"'),
        ("E070", '[R.A]\ntype="string"\nclone_of="B"\nconstant="x"\n[R.B]\ntype="string"\ncanonical_key="B"'),
        ("E070", '[R.A]\ntype="collection"\nclone_of="B"\n[R.B]\ntype="string"\ncanonical_key="B"'),
        ("E012", '[R.L]\ntype="collection"\ncanonical_key="L"\n[R.M]\ntype="collection"\ncanonical_key="M"\n[R.M.L]\ntype="collection"\ncanonical_key="L"'),
        ("E012", '[R.A]\ntype="string"\ncanonical_key="AbC"\n[R.B]\ntype="string"\ncanonical_key="Ab_c"'),
        ("E072", '[R.A]\ntype="string"\nclone_of="B"\n[R.B]\ntype="date"\ncanonical_key="B"'),
    ],
)
def test_findings(tmp_path, code, body):
    assert code in codes(tmp_path, body, META + ('source_model="other:1"\n' if code == "E020" else ""))


def test_paths_that_do_not_fit_the_shapes():
    plain = lambda i, kind="string", scope=None, xml=None: (i, kind, xml, None, scope, i.split(".")[1:] if not scope else [i.rpartition(".")[2]])
    # the shape R of an element inside is that of the root, which has a text B where B is a container
    _, told = shapes.laid_out("R", [plain("R.A.R.B"), plain("R.B.C")])
    assert [t[0] for t in told] == ["E024", "E021"]
    # a container named as the text of an element of the same shape
    paths, told = shapes.laid_out("R", [plain("R.A"), plain("R.A.C", xml="@c"), plain("R.L", "collection"), plain("R.L.X", scope="R.L")])
    assert told == [] and paths == {"R.A": "a.value", "R.A.C": "a.c", "R.L": "l", "R.L.X": "x"}


@pytest.mark.parametrize(
    "body",
    [
        '[R.A]\ntype="string"\nnormalize=["nope"]', '[R.A]\ntype="string"\nmultiple="last"', '[R.A]\ntype="string"\nrequired="yes"', '[R.A]\ntype="nope"',
        '[R.A]\ntype="collection"\nmin_items=-1', '[R.A]\ntype="collection"\nmin_items=true', '[R.A]\ntype="string"\nfallbacks="R.B"', '[R.A]\ntype="string"\nconstant=1',
    ],
)
def test_wrong_forms_and_words_are_fatal(tmp_path, body):
    (tmp_path / "a.toml").write_text(META + body)
    with pytest.raises(m.MappingError, match="E001"):
        m.compile_all(tmp_path)


@pytest.mark.parametrize("name", m.NEEDED)
def test_meta_fields_that_are_needed(tmp_path, name):
    (tmp_path / "a.toml").write_text("\n".join(line for line in META.split("\n") if not line.startswith(name)))
    with pytest.raises(m.MappingError, match=name):
        m.compile_all(tmp_path)


def test_disabled_nodes_go_with_what_is_below(tmp_path):
    (tmp_path / "a.toml").write_text(META + '[R.A]\ntype="string"\ncanonical_key="A"\n[R.A.B]\ntype="string"\nxml="@b"\ncanonical_key="B"\n[R.C]\ntype="string"\ncanonical_key="C"\n')
    (tmp_path / "b.toml").write_text(META.replace('"f"', '"g"') + 'inherits="f:1"\n[R.A]\ndisabled=true\n')
    c = m.compile_all(tmp_path)
    assert {s.id: s.covered() for s in c.spokes} == {"f:1": ["A", "B", "C"], "g:1": ["C"]}


def test_clean_mapping_has_no_findings(tmp_path):
    assert codes(tmp_path, '[R.A]\ntype="string"\ncanonical_key="A"\nfallbacks=["R.B"]\n[R.B]\ntype="identifier"') == set()


@pytest.mark.parametrize("body", ['[R.A]\ntype="string"\nwrong=1', 'x=1\n[R.A]\ntype="string"'])
def test_unknown_fields_are_fatal(tmp_path, body):
    meta = META if body.startswith("[") else ""
    (tmp_path / "a.toml").write_text(body + "\n" + META if not meta else META + body)
    with pytest.raises(m.MappingError, match="E001"):
        m.compile_all(tmp_path)


def test_unknown_parent_circle_and_empty_folder(tmp_path):
    with pytest.raises(m.MappingError):
        m.compile_all(tmp_path)
    (tmp_path / "a.toml").write_text(META + 'inherits="g:1"\n')
    with pytest.raises(m.MappingError, match="unknown parent"):
        m.compile_all(tmp_path)
    (tmp_path / "a.toml").write_text(META + 'inherits="f:1"\n')
    with pytest.raises(m.MappingError, match="circle"):
        m.compile_all(tmp_path)


def test_bundled_mappings():
    c = m.compile_all()
    assert not c.findings
    assert len(c.fields) == 150
    assert [(s.id, len(s.covered())) for s in c.spokes] == [("facturx-invoice:1.0", 148), ("fatturapa:1.2.2", 11), ("peppol-bis-billing:3.0", 150), ("ubl-invoice:2.1", 150), ("xrechnung-invoice:3.0.2", 150)]
    assert c["XRECHNUNG-invoice"].required() == ["InvoiceLines", "InvoiceNumber", "SpecificationId"]


@pytest.mark.parametrize(("name", "snake"), [("currencyID", "currency_id"), ("URIID", "uriid"), ("InvoiceLine", "invoice_line")])
def test_xml_names(name, snake):
    assert names.xml_snake(name) == snake
