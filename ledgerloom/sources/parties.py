"""Documents made from the customer table, with the features that invoices made from orders lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tag(name: str, body: Column | str, attributes: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(F.lit(f"<{name}"), as_column(attributes), F.lit(">"), as_column(body), F.lit(f"</{name}>"))


def from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a Party for every customer, shaped by the key k.

    Name: k % 5 = 0 only a blank Alias and Short, 1 Alias and Short, 2 Name and Alias. cur: k % 7 = 3 four letters. Copy:
    k % 4 = 0 none, 1 the same, 2 with one more digit, 3 another number. Day: k % 6 = 5 a word. First: k % 4 times.
    Single: k % 9 = 4 twice. Flag: k % 11 = 10 a wrong word. Unit by k % 5, Moment by k % 4. Order: k % 4 times, the
    second without Key where k % 3 = 0, with as many Stages as its place and the third a wrong day; k % 13 = 7 one that is empty.
    k % 10 = 0: marked as a member by CustomizationID.
    """
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    text = lambda prefix: F.concat(F.lit(prefix), k)
    by = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    balance = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    short = tag("Short", text("short-"))
    name = F.when(k % 5 == 0, F.concat(tag("Alias", " "), short)).when(k % 5 == 1, F.concat(tag("Alias", text(" alias-")), short))
    name = name.when(k % 5 == 2, F.concat(tag("Name", F.col("c_name")), tag("Alias", "a"))).otherwise(tag("Name", F.col("c_name")))
    unit = F.when(k % 7 == 3, "euro").otherwise(by(3, "eur", "usd", "gbp"))
    copy = F.when(k % 4 == 1, tag("Copy", balance)).when(k % 4 == 2, tag("Copy", F.concat(balance, F.lit("0")))).when(k % 4 == 3, tag("Copy", "0.001")).otherwise("")
    day = F.when(k % 6 == 5, "soon").otherwise(F.concat(F.lit("2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    times = lambda n, item: F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i > 0, item(i)).otherwise("")), "")
    first = times(k % 4, lambda i: tag("First", F.concat(F.lit("first-"), i)))
    single = F.concat(tag("Single", " "), tag("Single", text("s-")), F.when(k % 9 == 4, tag("Single", "more")).otherwise(""))
    flag = F.when(k % 11 == 10, "yes").otherwise(by(2, "true", " false "))
    stage = lambda j: tag("Stage", tag("Y", F.when(j == 3, "no").otherwise(F.concat(F.lit("2024-01-0"), j))))
    order = lambda i: tag("Order", F.concat(F.when((i % 2 == 0) & (k % 3 == 0), "").otherwise(tag("Key", F.concat(F.lit("key-"), i))), times(i, stage)))
    orders = F.when(k % 13 == 7, "<Order/>").otherwise(times(k % 4, order))
    parts = [
        F.when(k % 10 == 0, tag("CustomizationID", "urn:Member")).otherwise(""), name, tag("Balance", balance, F.concat(F.lit(' cur="'), unit, F.lit('"'))), copy, tag("Day", day), first, single,
        tag("Flag", flag), tag("Other", text("renamed-")), tag("Memo", text(" memo "), F.concat(F.lit(' lang="x-'), k % 3, F.lit('"'))), tag("Unit", by(5, "C62", "h", "KGM1", "a-b", "12345")),
        tag("Moment", by(4, "2024-01-02T10:11:12Z", "2024-01-02T24:00:00", "2024-01-02T10:11:12.5+01:00", "2024-01-02")), F.lit("<Extra><Name>x</Name><Name>y</Name></Extra>"), orders,
    ]
    return t.select(k.alias("doc_id"), F.concat(F.lit('<p:Party xmlns:p="urn:p">'), *parts, F.lit("</p:Party>")).alias("xml"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a Card for every customer, with two entries; k % 6 = 5 a wrong date, k % 8 = 1 not closed."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    entries = F.concat(*[tag("Entry", tag("No", f" {i} ")) for i in (1, 2)])
    date = tag("Date", F.when(k % 6 == 5, "soon").otherwise("2024-05-06"))
    return t.select(k.alias("doc_id"), F.concat(F.lit("<Card>"), tag("Label", F.col("c_name")), date, entries, F.when(k % 8 == 1, "").otherwise("</Card>")).alias("xml"))
