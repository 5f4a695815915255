"""Sources and sinks of invoice documents, and invoices made from order tables for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import DIAGNOSTIC, diagnostic_line, trim


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml): one row per file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("xml"))


def write_files(df: DataFrame, path: str, xml: str = "xml_out") -> None:
    """One document a line, for accepted rows; line feeds inside are kept as character references."""
    df.where(F.col(xml).isNotNull()).select(F.regexp_replace(trim(F.col(xml)), "\n", "&#10;").alias("value")).write.text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(xml): the documents that write_files() wrote."""
    return spark.read.text(path).select(F.col("value").alias("xml"))


def diagnostic_lines(df: DataFrame, column: str = "diagnostics") -> DataFrame:
    """(doc_id, position, line): `level [CODE] node: message`."""
    one = df.select("doc_id", F.posexplode(F.col(column).cast(f"array<{DIAGNOSTIC}>")).alias("position", "d"))
    return one.select("doc_id", "position", diagnostic_line(F.col("d")).alias("line"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, month, xml): a UBL invoice for every order, with faults that the order's key decides on.

    % 17 an empty number, % 19 none, % 13 a date with slashes, % 23 a currency of four letters, % 29 a decimal comma,
    % 31 an unclosed document, % 37 the date twice; key % 4 notes; key % 3 chooses the specification.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    # Parsing is the work here: both sides are dealt by order key to as many tasks as there are, which small inputs would
    # otherwise be gathered from; the grouping and the join need this partitioning anyway.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = t("lineitem").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.repartition(n, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    every = lambda n: k % n == 0
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    code = F.element_at(F.array(F.lit("eur"), F.lit("usd"), F.lit("gbp")), (F.coalesce("c_nationkey", F.lit(0)) % 3 + 1).cast("int"))
    number = F.when(every(19), "").when(every(17), "<ID></ID>").otherwise(tag("ID", F.concat(F.lit(" INV-"), k, F.lit(" "))))
    date = tag("IssueDate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    date = F.when(every(13), F.replace(date, F.lit("-"), F.lit(":"))).when(every(37), F.concat(date, date)).otherwise(date)
    special = F.when(k % 3 == 1, tag("CustomizationID", F.lit("urn:x:XRechnung:3"))).when(k % 3 == 2, tag("CustomizationID", F.lit("urn:x:peppol:3"))).otherwise("")
    notes = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("<Note> note "), i, F.lit("</Note>"))).otherwise("")), "")
    amount = F.when(every(29), F.replace(money("o_totalprice"), F.lit("."), F.lit(","))).otherwise(money("o_totalprice"))
    total = F.concat(F.lit('<LegalMonetaryTotal><PayableAmount currencyID="'), F.upper(code), F.lit('">'), amount, F.lit("</PayableAmount></LegalMonetaryTotal>"))
    rates = F.array_sort(F.array_distinct(F.transform(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), lambda x: F.round(x["l_tax"] * 100).cast("int"))))
    subtotal = lambda r: tag("TaxSubtotal", tag("TaxCategory", F.concat(F.lit("<ID>s</ID><Percent>"), r, F.lit("</Percent>"))))
    taxes = F.when(F.size(rates) > 0, tag("TaxTotal", F.array_join(F.transform(rates, subtotal), ""))).otherwise("")

    def item(x, i):
        dec = lambda f: x[f].cast("decimal(18,2)").cast("string")
        less = F.when(x["l_discount"] > 0, tag("AllowanceCharge", F.concat(F.lit("<ChargeIndicator>false</ChargeIndicator>"), tag("Amount", dec("l_discount"))))).otherwise("")
        name = tag("Item", tag("Name", F.concat(F.lit("part-"), x["l_partkey"].cast("string"))))
        amounts = [tag("InvoicedQuantity", dec("l_quantity")), tag("LineExtensionAmount", dec("l_extendedprice"))]
        return tag("InvoiceLine", F.concat(tag("ID", (i + 1).cast("string")), *amounts, less, name))

    body = F.coalesce(F.array_join(F.transform("lines", item), ""), F.lit(""))
    currency = tag("DocumentCurrencyCode", F.when(every(23), "euro").otherwise(code))
    xml = F.concat(F.lit("<Invoice>"), special, number, date, notes, currency, taxes, total, body, F.when(every(31), "").otherwise("</Invoice>"))
    return o.select(k.alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), xml.alias("xml"))
