"""The registered queries over invoices, with SQL that predicts their results from the order tables alone."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.engine import Engine
from ledgerloom.functions import text as X
from ledgerloom.operators import analysis
from ledgerloom.operators.detect import detected, root_name
from ledgerloom.plans import exercise
from ledgerloom.plans.footprints import PAIRS, footprints
from ledgerloom.plans.scratch import scratch
from ledgerloom.sources.invoices import diagnostic_lines, from_orders
from ledgerloom.streaming.jobs import read_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

GOOD = "o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0"
#: The orders as the invoices show them.
BASE = f"""
    WITH n AS (SELECT o_orderkey AS k, c_nationkey AS nation, o_orderdate AS d, o_totalprice AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT k, d, k % 31 <> 0 AND (k % 37 <> 0 OR k % 13 = 0) AS good,
                 CASE WHEN k % 19 = 0 OR k % 17 = 0 THEN NULL ELSE 'INV-' || k END AS invoice,
                 CASE WHEN k % 13 = 0 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS issued,
                 CASE WHEN k % 23 = 0 THEN 'EURO' ELSE ['EUR', 'USD', 'GBP'][coalesce(nation, 0) % 3 + 1] END AS code,
                 ['EUR', 'USD', 'GBP'][coalesce(nation, 0) % 3 + 1] AS tag,
                 CAST(CAST(total AS DECIMAL(18, 2)) AS VARCHAR) AS amount FROM n),
    l AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS i
          FROM lineitem AS l)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else BASE + sql if "{" not in sql else sql
        return f

    return keep


#: The keys that the invoices made from orders have values for.
KEYS = {"InvoiceNumber", "IssueDate", "DocumentCurrency", "InvoiceNote", "SpecificationId", "PayableAmount", "PayableAmountCurrency", "VatCategoryRate", "VatCategoryCode"}
KEYS |= {"LineId", "Quantity", "LineNetAmount", "ItemName", "LineAllowanceChargeAmount", "LineChargeIndicator"}


@cache
def engine() -> Engine:
    return Engine(keys=KEYS)


@cache
def whole() -> Engine:
    return Engine()


def read(spark: SparkSession, sf_dir: str, *keys: str, spoke: str = "ubl-invoice") -> DataFrame:
    """The invoices made from orders, with status, diagnostics, and these keys as columns."""
    return engine().fields(from_orders(spark, sf_dir), spoke, list(keys))


def items(spark: SparkSession, sf_dir: str, collection: str, *keys: str) -> DataFrame:
    """A row per element of a collection of the invoices that can be read."""
    return engine().items(from_orders(spark, sf_dir), "ubl-invoice", collection, list(keys))


def ok(df: DataFrame) -> DataFrame:
    return df.where("status = 'ok'")


@query(" SELECT k AS doc_id, invoice, issued, CASE WHEN k % 23 <> 0 THEN code END AS currency FROM h WHERE good")
def read_header(spark, sf_dir):
    """Root scalars: trimmed, upper-cased, checked."""
    rows = ok(read(spark, sf_dir, "InvoiceNumber", "IssueDate", "DocumentCurrency"))
    return rows.select("doc_id", F.col("invoice_number").alias("invoice"), F.col("issue_date").alias("issued"), F.col("document_currency").alias("currency"))


@query(" SELECT k AS doc_id, invoice FROM h WHERE k % 31 <> 0")
def one_field(spark, sf_dir):
    """Documents are parsed for one key alone: the status then speaks of this key's element only."""
    rows = engine().fields(from_orders(spark, sf_dir), "ubl-invoice", ["InvoiceNumber"], parse={"InvoiceNumber"})
    return ok(rows).select("doc_id", F.col("invoice_number").alias("invoice"))


@query(""" , t AS (SELECT k, CASE WHEN k % 31 = 0 THEN 'malformed' WHEN good THEN 'ok' ELSE 'repeated' END AS status,
        (invoice IS NULL)::INT + (k % 13 = 0)::INT + (k % 23 = 0)::INT + (k % 29 = 0)::INT + (k NOT IN (SELECT l_orderkey FROM lineitem))::INT AS faults FROM h)
    SELECT status, sum(CASE WHEN status = 'ok' THEN faults ELSE 0 END)::BIGINT AS n_told, count(*) AS n, count(CASE WHEN status = 'ok' AND k % 4 > 0 THEN 1 END) AS n_notes FROM t GROUP BY status""")
def whole_model(spark, sf_dir):
    """All 150 fields of the model are parsed and checked."""
    rows = whole().fields(from_orders(spark, sf_dir), "ubl-invoice", ["InvoiceNote"])
    return rows.groupBy("status").agg(F.sum(F.size("diagnostics")).alias("n_told"), F.count("*").alias("n"), F.count("invoice_note").alias("n_notes"))


@query(" SELECT k AS doc_id, CASE WHEN k % 29 <> 0 THEN amount END AS amount, tag AS currency FROM h WHERE good")
def read_attribute(spark, sf_dir):
    """An element's text and its attribute; decimals keep their digits."""
    rows = ok(read(spark, sf_dir, "PayableAmount", "PayableAmountCurrency"))
    return rows.select("doc_id", F.col("payable_amount").alias("amount"), F.col("payable_amount_currency").alias("currency"))


@query(" SELECT k AS doc_id, CAST(i - 1 AS INTEGER) AS line, CAST(i AS VARCHAR) AS line_id, CAST(CAST(l_quantity AS DECIMAL(18, 2)) AS VARCHAR) AS quantity, 'part-' || l_partkey AS item FROM h JOIN l ON k = l_orderkey WHERE good")
def read_lines(spark, sf_dir):
    """A collection's items in their order."""
    rows = items(spark, sf_dir, "InvoiceLines", "LineId", "Quantity", "ItemName")
    return rows.select("doc_id", F.col("position").alias("line"), "line_id", "quantity", F.col("item_name").alias("item"))


@query(" SELECT k AS doc_id, CAST(i AS VARCHAR) AS line_id, CAST(CAST(l_discount AS DECIMAL(18, 2)) AS VARCHAR) AS amount, false AS is_charge FROM h JOIN l ON k = l_orderkey WHERE good AND l_discount > 0")
def read_nested_lines(spark, sf_dir):
    """A collection within a collection."""
    rows = items(spark, sf_dir, "InvoiceLines", "LineId", "LineAllowanceCharges").select("doc_id", "line_id", F.explode("line_allowance_charges").alias("a"))
    return rows.select("doc_id", "line_id", F.col("a.line_allowance_charge_amount").alias("amount"), F.col("a.line_charge_indicator").alias("is_charge"))


@query(" SELECT k AS doc_id, CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS rate, 'S' AS category FROM h JOIN l ON k = l_orderkey WHERE good GROUP BY ALL")
def collection_in_container(spark, sf_dir):
    rows = items(spark, sf_dir, "VatBreakdown", "VatCategoryRate", "VatCategoryCode")
    return rows.select("doc_id", F.col("vat_category_rate").alias("rate"), F.col("vat_category_code").alias("category"))


@query(" SELECT k AS doc_id, count(l_orderkey) AS n_lines, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS total FROM h LEFT JOIN l ON k = l_orderkey WHERE good GROUP BY k")
def line_totals(spark, sf_dir):
    """Folded within the record: no shuffle."""
    lines = F.col("invoice_lines")
    total = F.aggregate(lines, F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + x["line_net_amount"].cast("decimal(18,2)")).cast("decimal(28,2)"))
    return ok(read(spark, sf_dir, "InvoiceLines/LineNetAmount")).select("doc_id", F.size(lines).cast("long").alias("n_lines"), total.cast("double").alias("total"))


def told(spark, sf_dir, code: str) -> DataFrame:
    rows = ok(read(spark, sf_dir)).select("doc_id", F.explode("diagnostics").alias("d")).where(F.col("d.code") == code)
    return rows.select("doc_id", F.col("d.source_node").alias("node"), F.col("d.severity").alias("severity"), F.col("d.message").alias("message"))


@query(" SELECT k AS doc_id, 'Invoice.ID' AS node, 'error' AS severity, 'required value is missing' AS message FROM h WHERE good AND invoice IS NULL")
def diag_required(spark, sf_dir):
    return told(spark, sf_dir, "REQUIRED_MISSING")


@query(""" , t AS (SELECT k, 'Invoice.IssueDate' AS node, replace(strftime(d, '%Y-%m-%d'), '-', ':') AS raw, 'date' AS kind FROM h WHERE good AND k % 13 = 0
    UNION ALL SELECT k, 'Invoice.DocumentCurrencyCode', 'EURO', 'currency code' FROM h WHERE good AND k % 23 = 0
    UNION ALL SELECT k, 'Invoice.LegalMonetaryTotal.PayableAmount', replace(amount, '.', ','), 'decimal' FROM h WHERE good AND k % 29 = 0)
    SELECT k AS doc_id, node, 'error' AS severity, '`' || raw || '` is not a valid ' || kind AS message FROM t""")
def diag_type(spark, sf_dir):
    return told(spark, sf_dir, "TYPE_INVALID")


@query(" SELECT k AS doc_id, 'InvoiceLine' AS node, 'error' AS severity, 'collection `InvoiceLines` has 0 items, expected at least 1' AS message FROM h WHERE good AND k NOT IN (SELECT l_orderkey FROM lineitem)")
def diag_min_items(spark, sf_dir):
    return told(spark, sf_dir, "MIN_ITEMS")


@query(" SELECT k AS doc_id, CASE WHEN k % 4 > 0 THEN array_to_string(['note 1', 'note 2', 'note 3'][1:(k % 4)::INTEGER], chr(10)) END AS note FROM h WHERE good")
def multi_join(spark, sf_dir):
    return ok(read(spark, sf_dir, "InvoiceNote")).select("doc_id", F.col("invoice_note").alias("note"))


@query(" SELECT CASE WHEN k % 31 = 0 THEN 'malformed' WHEN good THEN 'ok' ELSE 'repeated' END AS status, count(*) AS n FROM h GROUP BY 1")
def document_status(spark, sf_dir):
    """Unclosed documents and elements that stand twice."""
    return read(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(" SELECT CASE k % 3 WHEN 1 THEN 'xrechnung-invoice:3.0.2' WHEN 2 THEN 'peppol-bis-billing:3.0' ELSE 'ubl-invoice:2.1' END AS spoke, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM pages")
def detect_format(spark, sf_dir):
    """Invoices and web pages, by format."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").alias("xml"))
    return from_orders(spark, sf_dir).select("xml").unionByName(pages).groupBy(detected(F.col("xml"), engine().compiled.spokes).alias("spoke")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT page_id, html FROM pages) SELECT page_id, lower(regexp_extract(html, '<([A-Za-z]+)', 1)) AS root FROM x")
def detect_root(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(root_name(F.col("html"))).alias("root"))


@query(""" , e AS (SELECT k, good AND invoice IS NOT NULL AND k % 13 <> 0 AND k % 23 <> 0 AND k % 29 <> 0 AND k % 3 <> 0 AND k IN (SELECT l_orderkey FROM lineitem) AS accepted FROM h)
    SELECT accepted, count(*) AS n FROM e GROUP BY 1""")
def transform_accepted(spark, sf_dir):
    """UBL to a format that asks for more: the gate lets documents without an error pass."""
    return engine().transform(from_orders(spark, sf_dir), "ubl-invoice", "xrechnung-invoice").groupBy("accepted").agg(F.count("*").alias("n"))


@query(" SELECT k AS doc_id, invoice, issued, CASE WHEN k % 29 <> 0 THEN amount END AS amount, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS n_lines FROM h WHERE good")
def transform_roundtrip(spark, sf_dir):
    """UBL to a cross-industry document, written, and read again."""
    out = ok(engine().transform(from_orders(spark, sf_dir), "ubl-invoice", "facturx-invoice")).select("doc_id", "xml_out")
    # a record without any value has no document; these all have lines or amounts
    back = engine().fields(out, "facturx-invoice", ["InvoiceNumber", "IssueDate", "PayableAmount", "InvoiceLines/LineId"], "xml_out")
    named = {"invoice_number": "invoice", "issue_date": "issued", "payable_amount": "amount"}
    return back.select("doc_id", *[F.col(k).alias(v) for k, v in named.items()], F.size("invoice_lines").cast("long").alias("n_lines"))


@query(" SELECT k AS doc_id, invoice, CASE WHEN k % 29 <> 0 THEN amount END AS amount, NULL::VARCHAR AS note FROM h WHERE good")
def transform_to_fatturapa(spark, sf_dir):
    """Only what the target covers survives."""
    out = ok(engine().transform(from_orders(spark, sf_dir), "ubl-invoice", "fatturapa")).select("doc_id", "xml_out")
    back = engine().fields(out, "fatturapa", ["InvoiceNumber", "PayableAmount"], "xml_out")
    note = F.nullif(F.regexp_extract("xml_out", "<Note>([^<]*)</Note>", 1), F.lit(""))
    return back.select("doc_id", F.col("invoice_number").alias("invoice"), F.col("payable_amount").alias("amount"), note.alias("note"))


@query(" SELECT k AS doc_id, invoice IS NOT NULL AS has_number, k % 4 > 0 AS has_note, k IN (SELECT l_orderkey FROM lineitem) AS has_line, false AS has_supplier FROM h WHERE good")
def write_prunes_empty(spark, sf_dir):
    """Elements without any value are not written."""
    out = ok(engine().from_hub(engine().to_hub(from_orders(spark, sf_dir), "ubl-invoice"), "ubl-invoice"))
    has = lambda name: F.contains("xml_out", F.lit(f"<{name}>"))
    top = F.regexp_replace("xml_out", "(?s)<InvoiceLine>.*?</InvoiceLine>|<TaxTotal>.*?</TaxTotal>", "")
    elements = {"has_note": "Note", "has_line": "InvoiceLine", "has_supplier": "AccountingSupplierParty"}
    return out.select("doc_id", F.contains(top, F.lit("<ID>")).alias("has_number"), *[has(e).alias(name) for name, e in elements.items()])


@query(footprints() + PAIRS + "SELECT source, target, state, len(missing) AS n_missing, len(dropped) AS n_dropped FROM r")
def analyze_matrix(spark, sf_dir):
    return analysis.conversions(spark, whole().compiled).drop("detail")


@query(footprints() + "SELECT spoke, count(*) AS covered, (SELECT count(DISTINCT field) FROM c) - count(*) AS missing FROM c GROUP BY spoke")
def coverage_counts(spark, sf_dir):
    c = whole().compiled
    has = analysis.coverage(spark, c).groupBy("spoke").agg(F.count("*").alias("covered"))
    none = analysis.gaps(spark, c).groupBy("spoke").agg(F.count("*").alias("missing"))
    return has.join(none, "spoke", "left").select("spoke", "covered", F.coalesce("missing", F.lit(0)).alias("missing"))


@query(footprints() + "SELECT type, count(*) AS n FROM (SELECT field, min_by(type, spoke) AS type FROM c GROUP BY field) GROUP BY type")
def hub_fields(spark, sf_dir):
    return analysis.fields(spark, whole().compiled).groupBy("type").agg(F.count("*").alias("n"))


@query(footprints() + "SELECT field, " + ", ".join(f"bool_or(spoke = '{x.id}') AS {x.id.split(':')[0].replace('-', '_')}" for x in whole().compiled.spokes) + " FROM c GROUP BY field")
def coverage_matrix(spark, sf_dir):
    return analysis.matrix(spark, whole().compiled)


@query(footprints() + "SELECT s.spoke, f.field FROM (SELECT DISTINCT spoke FROM c) AS s, (SELECT DISTINCT field FROM c) AS f EXCEPT SELECT spoke, field FROM c")
def gap_report(spark, sf_dir):
    return analysis.gaps(spark, whole().compiled)


@query(footprints() + "SELECT field, string_agg(spoke, ',' ORDER BY spoke) AS defined_by, coalesce(string_agg(spoke, ',' ORDER BY spoke) FILTER (required), '') AS required_by FROM c GROUP BY field")
def key_listing(spark, sf_dir):
    return analysis.keys(spark, whole().compiled)


@query(footprints() + "SELECT has AS covered, count(*) AS n FROM (SELECT field, bool_or(spoke LIKE 'fatturapa:%') AS has FROM c GROUP BY field) GROUP BY has")
def spoke_keys(spark, sf_dir):
    return analysis.spoke_keys(spark, whole().compiled, "fatturapa").groupBy("covered").agg(F.count("*").alias("n"))


@query(""" , t AS (SELECT strftime(d, '%Y-%m') AS month, unnest(list_filter([CASE WHEN invoice IS NULL THEN 'REQUIRED_MISSING' END, CASE WHEN k % 13 = 0 THEN 'TYPE_INVALID' END, CASE WHEN k % 23 = 0 THEN 'TYPE_INVALID' END,
        CASE WHEN k % 29 = 0 THEN 'TYPE_INVALID' END, CASE WHEN k NOT IN (SELECT l_orderkey FROM lineitem) THEN 'MIN_ITEMS' END], lambda x: x IS NOT NULL)) AS code FROM h WHERE good)
    SELECT month, code, count(*) AS n FROM t GROUP BY ALL""")
def quality_by_month(spark, sf_dir):
    """Diagnostics per month and code, counted before they are shuffled."""
    return ok(read(spark, sf_dir)).select("month", F.explode("diagnostics").alias("d")).groupBy("month", F.col("d.code").alias("code")).agg(F.count("*").alias("n"))


@query(""" , t AS (SELECT k AS doc_id, list_filter([
        CASE WHEN k % 23 = 0 THEN '[TYPE_INVALID] Invoice.DocumentCurrencyCode: `EURO` is not a valid currency code' END,
        CASE WHEN invoice IS NULL THEN '[REQUIRED_MISSING] Invoice.ID: required value is missing' END,
        CASE WHEN k % 13 = 0 THEN '[TYPE_INVALID] Invoice.IssueDate: `' || strftime(d, '%Y:%m:%d') || '` is not a valid date' END,
        CASE WHEN k % 29 = 0 THEN '[TYPE_INVALID] Invoice.LegalMonetaryTotal.PayableAmount: `' || replace(amount, '.', ',') || '` is not a valid decimal' END,
        CASE WHEN k NOT IN (SELECT l_orderkey FROM lineitem) THEN '[MIN_ITEMS] InvoiceLine: collection `InvoiceLines` has 0 items, expected at least 1' END], lambda x: x IS NOT NULL) AS told
        FROM h WHERE good)
    SELECT doc_id, unnest(range(len(told)))::INTEGER AS position, 'error ' || unnest(told) AS line FROM t""")
def diagnostic_text(spark, sf_dir):
    """Every diagnostic of every document as a line of text."""
    return diagnostic_lines(ok(read(spark, sf_dir)))


@query("WITH x AS (SELECT c_custkey, c_mktsegment AS s FROM customer) SELECT c_custkey, lower(s) AS low, s AS up, nullif(s, 'BUILDING') AS other FROM x")
def normalise_chain(spark, sf_dir):
    s = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    other = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(s)
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = {"low": (s, ["trim", "lowercase"]), "up": (s, ["trim", "uppercase"]), "other": (other, ["trim", "empty_as_missing"])}
    return t.select("c_custkey", *[X.normalise(c, ops).alias(name) for name, (c, ops) in made.items()])


@query("""WITH d AS (SELECT event_id, event_id % 6 AS m FROM events) SELECT event_id, m IN (0, 4) AS is_date, m = 1 AS is_datetime, m IN (2, 5) AS is_decimal, m = 3 AS is_boolean FROM d""")
def valid_shapes(spark, sf_dir):
    """Values by the event's id: a date, a date-time, a decimal, a boolean, 30 February, a decimal with a sign."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_format("ts", "yyyy-MM-dd")
    choices = [day, F.concat(day, F.lit("T10:11:12.5+01:00")), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit(" true "), F.lit("2024-02-30"), F.lit(" +1.50 ")]
    v = F.get(F.array(*choices), (F.col("event_id") % 6).cast("int"))
    return t.select("event_id", *[X.valid(v, k).alias(f"is_{k}") for k in ("date", "datetime", "decimal", "boolean")])


@query(SQL["read_header"][len(BASE):])
def stream_equals_batch(spark, sf_dir):
    """The documents as a stream of Parquet files, read once and stopped."""
    folder = scratch(spark, "stream")
    from_orders(spark, sf_dir).select("doc_id", "xml").write.parquet(folder + "/in")
    stream = spark.readStream.schema("doc_id long, xml string").parquet(folder + "/in")
    read_stream(stream, engine().compiled["ubl-invoice"], folder + "/out", folder + "/state").awaitTermination()
    done = ok(spark.read.parquet(folder + "/out"))
    return done.select("doc_id", F.col("hub.invoice_number").alias("invoice"), F.col("hub.issue_date").alias("issued"), F.col("hub.document_currency").alias("currency"))


QUERIES |= exercise.QUERIES
SQL |= exercise.SQL
