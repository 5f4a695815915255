"""Static reports over the mappings: coverage, gaps, keys, and what a conversion loses. No document is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.mapping import Compiled


def fields(spark: SparkSession, c: Compiled) -> DataFrame:
    """(field, type): the canonical model."""
    return spark.createDataFrame(sorted(c.fields.items()), "field string, type string")


def coverage(spark: SparkSession, c: Compiled) -> DataFrame:
    """(spoke, field, required): what each format maps."""
    rows = [(s.id, f, f in s.required()) for s in c.spokes for f in s.covered()]
    return spark.createDataFrame(rows, "spoke string, field string, required boolean")


def spokes(spark: SparkSession, c: Compiled) -> DataFrame:
    return spark.createDataFrame([(s.id, s.root) for s in c.spokes], "spoke string, root string")


def matrix(spark: SparkSession, c: Compiled) -> DataFrame:
    """(field, one boolean a format)."""
    ids = [s.id for s in c.spokes]
    has = coverage(spark, c).groupBy("field").pivot("spoke", ids).agg(F.count(F.lit(1)) > 0)
    names = [F.coalesce(F.col(f"`{i}`"), F.lit(False)).alias(i.split(":")[0].replace("-", "_")) for i in ids]
    return fields(spark, c).select("field").join(has, "field", "left").select("field", *names)


def gaps(spark: SparkSession, c: Compiled) -> DataFrame:
    """(spoke, field): fields that a format does not map. Both sides are metadata of fixed size."""
    every = fields(spark, c).select("field").withColumn("spoke", F.explode(F.array(*[F.lit(s.id) for s in c.spokes])))
    return every.join(coverage(spark, c), ["spoke", "field"], "left_anti").select("spoke", "field").orderBy("spoke", "field")


def keys(spark: SparkSession, c: Compiled) -> DataFrame:
    """(field, defined_by, required_by): comma-joined formats."""
    joined = lambda x: F.array_join(F.sort_array(F.collect_set(x)), ",")
    return coverage(spark, c).groupBy("field").agg(joined("spoke").alias("defined_by"), joined(F.when(F.col("required"), F.col("spoke"))).alias("required_by"))


def spoke_keys(spark: SparkSession, c: Compiled, name: str) -> DataFrame:
    """(field, covered): the canonical model, split by whether one format has it."""
    own = coverage(spark, c).where(F.col("spoke") == c[name].id).select("field", F.lit(True).alias("covered"))
    return fields(spark, c).select("field").join(own, "field", "left").select("field", F.coalesce("covered", F.lit(False)).alias("covered"))


def conversions(spark: SparkSession, c: Compiled) -> DataFrame:
    """(source, target, state, n_missing, n_dropped, detail) for all pairs of formats.

    missing: required by the target, not covered by the source; dropped: covered by the source, not by the target.
    error: the target requires something, and the source has none of it. The detail tells three fields of what counts.
    """
    rows = [(s.id, s.covered(), s.required()) for s in c.spokes]
    one = spark.createDataFrame(rows, "source string, covered array<string>, required array<string>")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    targets = F.array(*[F.struct(F.lit(t.id).alias("target"), texts(t.covered()).alias("has"), texts(t.required()).alias("needs")) for t in c.spokes])
    pair = one.withColumn("t", F.explode(targets)).select("source", "covered", "t.*")
    pair = pair.withColumns({"missing": F.array_sort(F.array_except("needs", "covered")), "dropped": F.array_sort(F.array_except("covered", "has"))})
    none = (F.size("needs") > 0) & (F.size("missing") == F.size("needs"))
    state = F.when(none, "error").when(F.size("missing") > 0, "partial").when(F.size("dropped") > 0, "lossful").otherwise("lossless")

    def told(name: str, head: str):
        more = F.when(F.size(name) > 3, F.concat(F.lit(", (+"), F.size(name) - 3, F.lit(" more)"))).otherwise("")
        return F.concat(F.lit(head), F.array_join(F.slice(name, 1, 3), ", "), more)

    detail = F.when(F.size("missing") > 0, told("missing", "missing required ")).when(F.size("dropped") > 0, told("dropped", "drops ")).otherwise("—")
    n = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return pair.select("source", "target", state.alias("state"), n("missing"), n("dropped"), detail.alias("detail"))


def fallbacks(spark: SparkSession, c: Compiled) -> DataFrame:
    """(spoke, node, fallback, position): each node's fallbacks in their order."""
    rows = [(s.id, n.id, f, k) for s in c.spokes for n in s.nodes.values() for k, f in enumerate(n.fallbacks)]
    return spark.createDataFrame(rows, "spoke string, node string, fallback string, position int")
