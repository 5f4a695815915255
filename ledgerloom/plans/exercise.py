"""Registered queries for the features that the bundled formats don't use, over parties made from customers, for detection,
for the mapping compiler and for files; with SQL that predicts their results from the tables and the mapping files."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.engine import Engine
from ledgerloom.functions import text as X
from ledgerloom.operators import analysis, reports
from ledgerloom.operators.detect import customization
from ledgerloom.operators.mixed import equal_plans
from ledgerloom.plans import mapping
from ledgerloom.plans.footprints import PAIRS, footprints
from ledgerloom.plans.scratch import scratch
from ledgerloom.sources import invoices
from ledgerloom.sources.parties import cards, from_customers

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The customers as the documents show them.
BASE = """
    WITH p AS (SELECT c_custkey AS k, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS balance FROM customer),
    h AS (SELECT *, CASE k % 5 WHEN 0 THEN 'short-' || k WHEN 1 THEN 'alias-' || k ELSE c_name END AS name,
                 CASE WHEN k % 7 = 3 THEN 'EURO' ELSE ['EUR', 'USD', 'GBP'][k % 3 + 1] END AS code,
                 CASE WHEN k % 6 <> 5 THEN '2024-' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS day,
                 CASE WHEN k % 13 = 7 THEN []::BIGINT[] ELSE list_filter(range(1, k % 4 + 1), lambda i: NOT (i % 2 = 0 AND k % 3 = 0)) END AS keyed,
                 CASE WHEN k % 13 = 7 THEN [0]::BIGINT[] WHEN k % 4 >= 2 AND k % 3 = 0 THEN [1]::BIGINT[] ELSE []::BIGINT[] END AS unkeyed FROM p)"""

X.register("day_of_digits", lambda c: F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3"), lambda c: F.when(~c.rlike(r"^\d{8}\z"), "not eight digits"))


def query(sql: str, base: str = BASE):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = base + sql
        return f

    return keep


@cache
def engine() -> Engine:
    return Engine(mapping.HERE / "exercise")


def read(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return engine().fields(from_customers(spark, sf_dir), "party", list(keys)).where("status = 'ok'")


def told(df: DataFrame, code: str, column: str = "diagnostics") -> DataFrame:
    """A row per diagnostic of one code."""
    d = df.select("doc_id", F.explode(column).alias("d")).where(F.col("d.code") == code)
    named = {"severity": "severity", "source_node": "node", "canonical_key": "key", "source_path": "path", "collection_index": "at", "message": "message"}
    return d.select("doc_id", F.array_join("d.fallback_chain", ",").alias("chain"), *[F.col(f"d.{k}").alias(v) for k, v in named.items()])


def rows(severity: str, node: str, key: str, path: str, message: str, where: str, chain: str = "", at: str = "NULL::INTEGER") -> str:
    """SQL of what told() gives."""
    return f" SELECT k AS doc_id, '{severity}' AS severity, '{node}' AS node, '{key}' AS key, {path} AS path, {at} AS at, '{chain}' AS chain, {message} AS message FROM h WHERE {where}"


CHAIN = "Party.Alias,Party.Short"


@query(" SELECT k AS doc_id, name FROM h")
def fallback_values(spark, sf_dir):
    """The first of a value and its fallbacks that is there; each is normalised by its own rules."""
    return read(spark, sf_dir, "Name").select("doc_id", "name")


@query(rows("info", "Party.Name", "Name", "'alias'", "'used fallback `Party.Alias` for `Name`'", "k % 5 = 1", CHAIN) + " UNION ALL" + rows("info", "Party.Name", "Name", "'short'", "'used fallback `Party.Short` for `Name`'", "k % 5 = 0", CHAIN))
def fallback_told(spark, sf_dir):
    return told(read(spark, sf_dir), "FALLBACK_USED")


@query(rows("warning", "Party.Copy", "Balance", "'copy'", "'copy value `0.001` does not match the canonical `Balance` value'", "k % 4 = 3"))
def copies_that_differ(spark, sf_dir):
    """Copies are compared as numbers: another number of digits is no difference."""
    return told(read(spark, sf_dir), "CLONE_MISMATCH")


@query(" SELECT k AS doc_id, CASE WHEN k % 4 > 0 THEN 'first-1' END AS first, CASE WHEN k % 9 <> 4 THEN 's-' || k END AS single FROM h")
def one_of_many(spark, sf_dir):
    """The first of repeated values, and a value that may not repeat; blank ones don't count."""
    return read(spark, sf_dir, "First", "Single").select("doc_id", "first", "single")


@query(rows("warning", "Party.First", "First", "'first'", "'using the first of ' || k % 4 || ' values for `First`'", "k % 4 > 1") + " UNION ALL" + rows("error", "Party.Single", "Single", "'single'", "'found 2 values for single-valued `Single`'", "k % 9 = 4"))
def many_told(spark, sf_dir):
    return told(read(spark, sf_dir), "MULTIPLE_VALUES")


@query(" SELECT k AS doc_id, CASE WHEN k % 7 <> 3 THEN code END AS currency, day FROM h")
def adapted(spark, sf_dir):
    """Adapters run before a value is checked."""
    return read(spark, sf_dir, "BalanceCurrency", "Day").select("doc_id", F.col("balance_currency").alias("currency"), "day")


@query(rows("error", "Party.Day", "Day", "NULL::VARCHAR", "'adapter `day_of_digits` failed: not eight digits'", "k % 6 = 5"))
def adapter_failed(spark, sf_dir):
    return told(read(spark, sf_dir), "ADAPTER_FAILED")


@query(" SELECT k AS doc_id, 'renamed-' || k AS renamed, 'memo ' || k AS memo, 'x-' || k % 3 AS lang FROM h")
def renamed_and_text(spark, sf_dir):
    """An element of another name than its node, an element's text beside its attribute; unmapped elements may repeat."""
    return read(spark, sf_dir, "Renamed", "Memo", "MemoLang").select("doc_id", "renamed", "memo", F.col("memo_lang").alias("lang"))


@query(""" SELECT k AS doc_id, CASE WHEN k % 11 <> 10 THEN k % 2 = 0 END AS flag, ['C62', 'h', NULL, NULL, NULL][k % 5 + 1] AS unit,
    ['2024-01-02T10:11:12Z', NULL, '2024-01-02T10:11:12.5+01:00', NULL][k % 4 + 1] AS moment FROM h""")
def checked_types(spark, sf_dir):
    """Booleans, unit codes and date-times; what fails its check is null."""
    return read(spark, sf_dir, "Flag", "Unit", "Moment").select("doc_id", "flag", "unit", "moment")


@query(
    rows("error", "Party.Balance.Unit", "BalanceCurrency", "NULL::VARCHAR", "'`EURO` is not a valid currency code'", "k % 7 = 3")
    + " UNION ALL" + rows("error", "Party.Flag", "Flag", "NULL::VARCHAR", "'`yes` is not a valid boolean'", "k % 11 = 10")
    + " UNION ALL" + rows("error", "Party.Unit", "Unit", "NULL::VARCHAR", "'`' || ['', '', 'KGM1', 'a-b', '12345'][k % 5 + 1] || '` is not a valid unit code'", "k % 5 > 1")
    + " UNION ALL" + rows("error", "Party.Moment", "Moment", "NULL::VARCHAR", "'`' || ['', '2024-01-02T24:00:00', '', '2024-01-02'][k % 4 + 1] || '` is not a valid date-time'", "k % 2 = 1")
    + " UNION ALL" + rows("error", "Party.Order.Stage.Y", "StageDay", "NULL::VARCHAR", "'`no` is not a valid date'", "k % 4 = 3 AND k % 13 <> 7", at="2")
)
def types_told(spark, sf_dir):
    """The index of an item is that of the innermost collection."""
    return told(read(spark, sf_dir), "TYPE_INVALID")


@query(rows("error", "Party.Order.Key", "OrderKey", "'key'", "'required value is missing'", "len(unkeyed) > 0", at="unkeyed[1]::INTEGER"))
def items_told(spark, sf_dir):
    return told(read(spark, sf_dir), "REQUIRED_MISSING")


@query(""" SELECT k AS doc_id, (i - 1)::INTEGER AS position, CASE WHEN list_contains(keyed, i) THEN 'key-' || i END AS key, CASE WHEN k % 13 = 7 THEN 0 ELSE i END::INTEGER AS n_stages
    FROM (SELECT *, unnest(CASE WHEN k % 13 = 7 THEN [1]::BIGINT[] ELSE range(1, k % 4 + 1) END) AS i FROM h)""")
def items_in_order(spark, sf_dir):
    """Every element of a collection, the empty ones too."""
    items = engine().items(from_customers(spark, sf_dir), "party", "Orders", ["OrderKey", "Stages"])
    return items.select("doc_id", "position", F.col("order_key").alias("key"), F.size("stages").alias("n_stages"))


@query(""" SELECT k AS doc_id, '<Card><Again>' || balance || '</Again>' || coalesce('<Date>' || day || '</Date>', '')
    || array_to_string(list_transform(keyed, lambda i: '<Entry><No>key-' || i || '</No><Sort>k</Sort></Entry>'), '') || '<Kind>380</Kind><Label>' || name || '</Label>'
    || CASE WHEN k % 4 > 0 THEN '<Note>first-1</Note>' ELSE '' END || '<Total' || CASE WHEN k % 7 <> 3 THEN ' unit="' || code || '"' ELSE '' END || '>' || balance || '</Total></Card>' AS xml FROM h""")
def written_documents(spark, sf_dir):
    """The whole text: order of elements, constants, copies, attributes, and no empty elements."""
    out = engine().transform(from_customers(spark, sf_dir), "party", "card")
    return out.select("doc_id", F.regexp_replace("xml_out", r"\n\s*", "").alias("xml"))


@query(" SELECT k AS doc_id, CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END AS n_first, 1 AS n_single_or_none, len(keyed)::INTEGER AS n_sorts FROM h")
def written_once(spark, sf_dir):
    """A value that was read from many elements is written as one; constants stand only in items that have more."""
    out = engine().transform(from_customers(spark, sf_dir), "party", "party")
    n = lambda name: F.size(F.regexp_extract_all("xml_out", F.lit(f"<{name}>"), F.lit(0)))
    # items without a key are written for their stages: only those that are empty else are left out
    sorts = F.size(F.regexp_extract_all("xml_out", F.lit("<Order><Key>[^<]*</Key><Sort>k</Sort>"), F.lit(0)))
    return out.select("doc_id", n("First").alias("n_first"), F.lit(1).alias("n_single_or_none"), sorts.alias("n_sorts"))


@query(
    """, t AS (SELECT k, list_filter([CASE WHEN day IS NULL THEN 'REQUIRED_MISSING Card.Date required value is missing' END,
        CASE WHEN len(keyed) < 2 THEN 'MIN_ITEMS Card.Entry collection `Orders` has ' || len(keyed) || ' items, expected at least 2' END], lambda x: x IS NOT NULL) AS said FROM h)
    SELECT k AS doc_id, unnest(range(len(said)))::INTEGER AS position, unnest(said) AS line FROM t"""
)
def writing_told(spark, sf_dir):
    """What the target asks for: checked when it is written, after what was told when the source was read."""
    out = engine().transform(from_customers(spark, sf_dir), "party", "card")
    notes = F.filter("diagnostics", lambda d: d["source_node"].startswith("Card."))
    return out.select("doc_id", F.posexplode(notes).alias("position", "d")).select("doc_id", "position", F.concat_ws(" ", "d.code", "d.source_node", "d.message").alias("line"))


#: SQL of whether a party converts to a party without an error.
CLEAN = "(k % 9 <> 4 AND k % 6 <> 5 AND k % 7 <> 3 AND k % 11 <> 10 AND k % 5 < 2 AND k % 4 = 2 AND k % 13 <> 7 AND k % 3 <> 0)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties, cards and web pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return from_customers(spark, sf_dir).unionByName(cards(spark, sf_dir)).unionByName(pages)


@query(f""", t AS (SELECT CASE WHEN k % 10 = 0 THEN 'member:1' ELSE 'party:1' END AS spoke, 'ok' AS status, {CLEAN} AS accepted FROM h
    UNION ALL SELECT 'card:1', CASE WHEN k % 8 = 1 THEN 'malformed' ELSE 'ok' END, k % 8 <> 1 AND k % 6 <> 5 FROM h)
    SELECT spoke, status, accepted, count(*) AS n FROM t GROUP BY ALL""")
def mixed_formats(spark, sf_dir):
    """Documents of three formats to one, in one pass."""
    return engine().transform_mixed(mixed(spark, sf_dir), "party").groupBy("spoke", "status", "accepted").agg(F.count("*").alias("n"))


@query(f""", t AS (SELECT CASE WHEN {CLEAN} THEN 200 ELSE 422 END AS http_status FROM h UNION ALL SELECT CASE WHEN k % 8 = 1 THEN 400 WHEN k % 6 = 5 THEN 422 ELSE 200 END FROM h UNION ALL SELECT 400 FROM pages)
    SELECT http_status, count(*) AS n FROM t GROUP BY 1""")
def replies(spark, sf_dir):
    """What a service would answer, by its status."""
    return engine().replies(mixed(spark, sf_dir), "party").groupBy("http_status").agg(F.count("*").alias("n"))


#: SQL of orders with a CustomizationID inside what is no text, by key.
MARKS = """SELECT o_orderkey AS doc_id, ['', '', 'urn:peppol', 'urn', '', 'a xrechnung b', ''][o_orderkey % 7 + 1] AS mark FROM orders"""


@query(MARKS, "")
def marks(spark, sf_dir):
    """The first text of a CustomizationID, where comments, CDATA and processing instructions hold others."""
    inside = [
        "<!-- <CustomizationID>urn:xrechnung</CustomizationID> -->", "<Note><![CDATA[<CustomizationID>peppol</CustomizationID>]]></Note>", "<CustomizationID><!-- x -->urn:peppol</CustomizationID>",
        "<CustomizationID>urn<!-- -->peppol</CustomizationID>", "<CustomizationID a='b'/><Note>peppol</Note>", "<a:CustomizationID> </a:CustomizationID><a:CustomizationID> a xrechnung b </a:CustomizationID>", "<ID>1</ID>",
    ]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    xml = F.concat(F.lit("<?xml version='1.0'?><Invoice>"), F.get(F.array(*[F.lit(x) for x in inside]), (F.col("o_orderkey") % 7).cast("int")), F.lit("</Invoice>"))
    return o.select(F.col("o_orderkey").alias("doc_id"), customization(xml).alias("mark"))


@query("SELECT c_custkey AS doc_id, c_name AS trimmed, upper(c_name) AS up, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS present FROM customer", "")
def normalise_unicode(spark, sf_dir):
    """Blanks of every script go at both ends; a text of nothing else is empty, and missing where that is asked for."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wide = F.concat(F.lit("  \u0085\t"), F.col("c_name"), F.lit("　 \n "))
    some = F.when(F.col("c_custkey") % 2 == 0, wide).otherwise("  ")
    made = {"trimmed": (wide, ["trim"]), "up": (wide, ["uppercase", "trim"]), "present": (some, ["trim", "empty_as_missing"])}
    return t.select(F.col("c_custkey").alias("doc_id"), *[X.normalise(c, ops).alias(name) for name, (c, ops) in made.items()])


@query("SELECT n_nationkey AS doc_id, '<Party><Name>' || n_name || '</Name></Party>' AS xml FROM nation", "")
def whole_files(spark, sf_dir):
    """One document a file, written and read again."""
    folder = scratch(spark, "files")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    body = F.concat(F.lit("<Party><Name>"), F.col("n_name"), F.lit("</Name></Party>"))
    n.select(F.col("n_nationkey").alias("id"), body.alias("value")).repartition(1).write.partitionBy("id").option("lineSep", "\n").text(folder)
    back = invoices.files(spark, folder)
    return back.select(F.regexp_extract("doc_id", r"id=(\d+)", 1).cast("int").alias("doc_id"), F.regexp_replace("xml", r"\n\z", "").alias("xml"))


@query(f" SELECT count(*) AS n, sum(CASE WHEN {CLEAN} THEN 1 ELSE 0 END)::BIGINT AS n_same FROM h WHERE {CLEAN}")
def accepted_lines(spark, sf_dir):
    """Accepted documents, a line each, written, read again and converted again to the same text, but for the day, whose
    adapter takes digits only."""
    folder = scratch(spark, "lines")
    out = engine().transform(from_customers(spark, sf_dir), "party", "party").where("accepted")
    invoices.write_files(out, folder)
    again = engine().transform(invoices.lines(spark, folder), "party", "party")
    same = F.regexp_replace("xml", "<Day>[^<]*</Day>|&#10;", "") == F.regexp_replace("xml_out", "\n", "")
    return again.agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("n_same"))


EXERCISE = footprints(str(mapping.HERE / "exercise"))


@query("SELECT field, min(type) AS type FROM c GROUP BY field", EXERCISE)
def scope_labels(spark, sf_dir):
    """Canonical fields with the collections around them, outermost first."""
    return analysis.fields(spark, engine().compiled)


@query("SELECT spoke, id AS node, 'Party.' || f.name AS fallback, f.place AS position FROM c, (VALUES ('Alias', 0), ('Short', 1)) AS f(name, place) WHERE field = 'Name' AND spoke <> 'card:1'", EXERCISE)
def fallback_graph(spark, sf_dir):
    return analysis.fallbacks(spark, engine().compiled)


@query("SELECT spoke, CASE WHEN spoke = 'card:1' THEN spoke ELSE 'member:1' END AS leader FROM c GROUP BY spoke", EXERCISE)
def equal_formats(spark, sf_dir):
    """Formats that are read alike, with the first of their group."""
    return spark.createDataFrame([(s.id, own[0].id) for own in equal_plans(engine().compiled.spokes) for s in own], "spoke string, leader string")


@query("SELECT '[' || string_agg('\"' || spoke || '\"', ',' ORDER BY spoke) || ']' AS formats FROM (SELECT DISTINCT spoke FROM c)", footprints())
def format_list(spark, sf_dir):
    """The names of all formats, as a service tells them."""
    return analysis.spokes(spark, mapping.compile_all()).agg(F.to_json(F.sort_array(F.collect_list("spoke"))).alias("formats"))


NAMES = ["UBL-Invoice", "xrechnung-invoice", "XRECHNUNG-INVOICE:3.0.2", "facturx-invoice:9", "fatturapa", "peppol", "peppol-bis-billing"]


@query(
    ", v AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS name) SELECT name, (SELECT min(spoke) FROM c WHERE lower(v.name) IN (lower(spoke), lower(split_part(spoke, ':', 1)))) AS spoke FROM v",
    footprints(),
)
def names_resolved(spark, sf_dir):
    c = mapping.compile_all()

    def found(name: str) -> str | None:
        try:
            return c[name].id
        except KeyError:
            return None

    return spark.createDataFrame([(n, found(n)) for n in NAMES], "name string, spoke string")


DETAIL = """CASE WHEN len(missing) > 0 THEN 'missing required ' || array_to_string(missing[1:3], ', ') || CASE WHEN len(missing) > 3 THEN ', (+' || len(missing) - 3 || ' more)' ELSE '' END
    WHEN len(dropped) > 0 THEN 'drops ' || array_to_string(dropped[1:3], ', ') || CASE WHEN len(dropped) > 3 THEN ', (+' || len(dropped) - 3 || ' more)' ELSE '' END ELSE '—' END"""


@query(f"SELECT source, target, state, {DETAIL} AS detail FROM r", EXERCISE + PAIRS)
def conversion_detail(spark, sf_dir):
    return analysis.conversions(spark, engine().compiled).select("source", "target", "state", "detail")


@query(
    f""", x AS (SELECT source, target, map {{'lossless': '=', 'lossful': '~', 'partial': '!', 'error': 'x'}}[state] AS sign, {DETAIL} AS detail FROM r),
    w AS (SELECT max(length(source))::INTEGER AS a, max(length(target))::INTEGER AS b FROM x)
    SELECT row_number() OVER (ORDER BY source, target)::INTEGER AS place, rpad(source, a, ' ') || ' | ' || rpad(target, b, ' ') || ' | ' || sign || ' | ' || detail AS line FROM x, w""",
    footprints() + PAIRS,
)
def conversion_lines(spark, sf_dir):
    """The rows of the conversion report as text, below its heading."""
    lines = reports.conversion_table(spark, mapping.compile_all()).split("\n\n")[0].split("\n")
    return spark.createDataFrame(list(enumerate(lines))[1:], "place int, line string")


@query(
    """, s AS (SELECT DISTINCT spoke FROM c), f AS (SELECT DISTINCT field FROM c)
    SELECT '| ' || f.field || ' | ' || string_agg(CASE WHEN c.field IS NULL THEN '·' ELSE '✓' END, ' | ' ORDER BY s.spoke) || ' |' AS line FROM f CROSS JOIN s LEFT JOIN c ON c.field = f.field AND c.spoke = s.spoke GROUP BY f.field""",
    footprints(),
)
def coverage_lines(spark, sf_dir):
    """The rows of the coverage table in Markdown."""
    lines = reports.coverage_markdown(mapping.compile_all()).split("\n\n")[1].split("\n")[2:]
    return spark.createDataFrame([(x,) for x in lines if x], "line string")


META = '[meta]\ndoc_format="f"\nformat_version="1"\nmapping_version="1"\ncanonical_model="c"\nroot="R"\n'
A, B = '[R.A]\ntype="string"\ncanonical_key="A"\n', '[R.B]\ntype="string"\ncanonical_key="B"\n'
LIST = '[R.L]\ntype="collection"\ncanonical_key="L"\n'
#: Mappings with a fault each, by name.
FAULTS = {
    "no fault": A + B,
    "unknown field": A + "wrong=1\n",
    "unknown normaliser": A + 'normalize=["nope"]\n',
    "unknown policy": A + 'multiple="last"\n',
    "wrong form": A + 'required="yes"\n',
    "no type": '[R.A]\ncanonical_key="A"\n',
    "unkeyed collection": '[R.L]\ntype="collection"\n[R.L.A]\ntype="string"\ncanonical_key="A"\n',
    "collection in two scopes": LIST + '[R.M]\ntype="collection"\ncanonical_key="M"\n[R.M.L]\ntype="collection"\ncanonical_key="L"\n',
    "two keys of one column": '[R.A]\ntype="string"\ncanonical_key="AbC"\n[R.B]\ntype="string"\ncanonical_key="Ab_c"\n',
    "key mapped twice": A + '[R.B]\ntype="string"\ncanonical_key="A"\n',
    "another model": A,
    "element in two shapes": '[R.A.X]\ntype="string"\n[R.B.A.X.Y]\ntype="string"\n',
    "multiple collection": LIST + 'multiple="first"\n',
    "no such fallback": A + 'fallbacks=["R.X"]\n',
    "fallback of another type": A + 'fallbacks=["R.B"]\n[R.B]\ntype="date"\n',
    "fallback elsewhere": A + 'fallbacks=["R.L.B"]\n' + LIST + '[R.L.B]\ntype="string"\n',
    "fallbacks in a circle": A + 'fallbacks=["R.B"]\n[R.B]\ntype="string"\nfallbacks=["R.A"]\n',
    "join without separator": A + 'multiple="join"\n',
    "separator without join": A + 'join_with=","\n',
    "minimum of a scalar": A + "min_items=1\n",
    "multiple with fallbacks": A + 'multiple="first"\nfallbacks=["R.B"]\n[R.B]\ntype="string"\n',
    "unknown adapter": A + 'adapter="nope"\n',
    "constant collection": LIST + 'constant="x"\n',
    "constant of another type": '[R.A]\ntype="decimal"\ncanonical_key="A"\nconstant="1."\n',
    "constant with normalising": A + 'constant="x"\nnormalize=["trim"]\n',
    "copy with a constant": A + '[R.C]\ntype="string"\nclone_of="A"\nconstant="x"\n',
    "copy of nothing": '[R.C]\ntype="string"\nclone_of="A"\n',
    "copy of another type": A + '[R.C]\ntype="date"\nclone_of="A"\n',
}


@query(
    """SELECT * FROM (VALUES ('no fault', ''), ('unknown field', 'E001'), ('unknown normaliser', 'E001'), ('unknown policy', 'E001'), ('wrong form', 'E001'), ('no type', 'E002'), ('unkeyed collection', 'E011'),
    ('collection in two scopes', 'E012'), ('two keys of one column', 'E012'), ('key mapped twice', 'E013'), ('another model', 'E020'), ('element in two shapes', 'E021,E024'), ('multiple collection', 'E021,E024'),
    ('no such fallback', 'E030'), ('fallback of another type', 'E031'), ('fallback elsewhere', 'E032'), ('fallbacks in a circle', 'E033'), ('join without separator', 'E040'), ('separator without join', 'E040'),
    ('minimum of a scalar', 'E041'), ('multiple with fallbacks', 'E043'), ('unknown adapter', 'E050'), ('constant collection', 'E060'), ('constant of another type', 'E061'), ('constant with normalising', 'E062'),
    ('copy with a constant', 'E070'), ('copy of nothing', 'E071'), ('copy of another type', 'E072')) AS t(fault, codes)""",
    "",
)
def mapping_faults(spark, sf_dir):
    """The codes found in mappings with a fault each. No table is read."""

    def codes(fault: str, body: str) -> str:
        try:
            made = mapping.compiled(mapping.loaded([META + ('source_model="g:1"\n' if fault == "another model" else "") + body]))
        except mapping.MappingError as e:
            return str(e).split(":")[0]
        return ",".join(sorted({f.code for f in made.findings}))

    return spark.createDataFrame([(k, codes(k, v)) for k, v in FAULTS.items()], "fault string, codes string")


#: A parent, a child that takes a node with all below it away and replaces another, and a parent that is no format itself.
FAMILY = [
    META + A + '[R.A.X]\ntype="string"\nxml="@x"\ncanonical_key="X"\n' + B + LIST + '[R.L.Y]\ntype="string"\ncanonical_key="Y"\n',
    META.replace('"f"', '"g"') + 'inherits="f:1"\n[R.A]\ndisabled=true\n[R.B]\ntype="string"\ncanonical_key="B2"\nrequired=true\n',
    META.replace('"f"', '"base"') + "disabled=true\n" + A,
    META.replace('"f"', '"h"') + 'inherits="base:1"\n' + B,
]


@query(
    """SELECT * FROM (VALUES ('f:1', 'A', false), ('f:1', 'X', false), ('f:1', 'B', false), ('f:1', 'L', false), ('f:1', 'L/Y', false), ('g:1', 'B2', true), ('g:1', 'L', false), ('g:1', 'L/Y', false),
    ('h:1', 'A', false), ('h:1', 'B', false)) AS t(spoke, field, required)""",
    "",
)
def inherited(spark, sf_dir):
    """What formats cover that inherit from others: whole nodes are replaced, disabled ones go with what is below them."""
    return analysis.coverage(spark, mapping.compiled(mapping.loaded(FAMILY)))


LOADED = {
    "nothing wrong": [META + A],
    "twice": [META + A, META + B],
    "unknown parent": [META + 'inherits="g:1"\n' + A],
    "circle": [META + 'inherits="g:1"\n' + A, META.replace('"f"', '"g"') + 'inherits="f:1"\n' + B],
    "no meta": [A],
    "meta without a version": [META.replace('format_version="1"\n', "") + A],
    "value outside of tables": ["x=1\n" + META + A],
    "not TOML": ["[meta\n"],
}


@query("SELECT * FROM (VALUES ('nothing wrong', true), ('twice', false), ('unknown parent', false), ('circle', false), ('no meta', false), ('meta without a version', false), ('value outside of tables', false), ('not TOML', false)) AS t(files, loads)", "")
def mapping_files_that_load(spark, sf_dir):
    """Sets of mapping files that can't be loaded at all."""

    def loads(texts: list[str]) -> bool:
        try:
            mapping.compiled(mapping.loaded(texts))
        except mapping.MappingError:
            return False
        return True

    return spark.createDataFrame([(k, loads(v)) for k, v in LOADED.items()], "files string, loads boolean")
