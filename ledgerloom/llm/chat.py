"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once for each turn it had. Every conversation's turns get rolling prefix hashes; one
whose whole hash is a proper prefix of a longer one is such a snapshot, and an anti-join drops it. What remains is
rendered with a template of role marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, role, text) of the conversations that are no proper prefix of another; at counts turns from 1.

    Of equal conversations the smallest conv_id stays. Turns are ordered by turn, then role and text; null roles and
    texts compare as values of their own and are rendered empty. Rows with a null conv_id form one conversation.
    Empty tables give empty results.
    """
    named = {"conv_id": (conv, "long"), "turn": (turn, "long"), "role": (role, "string"), "text": (text, "string")}
    rows = turns.select(*[F.col(quoted(c)).cast(kind).alias(name) for name, (c, kind) in named.items()])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # place, role and text of a turn are hashed together, so the exclusive-or over the turns so far knows their order
    said = [F.coalesce(F.col("role"), F.lit("\0")), F.coalesce(F.col("text"), F.lit("\0"))]
    rows = rows.withColumns({"h": F.bit_xor(F.xxhash64("at", *said)).over(so_far), "g": F.bit_xor(F.xxhash64(F.lit(1), *said, "at")).over(so_far)})
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    whole = rows.where("at = n").select("conv_id", "n", "h", "g")
    inner = rows.where("at < n").select(F.col("at").alias("n"), "h", "g").distinct()
    first = whole.groupBy("n", "h", "g").agg(F.min("conv_id").alias("conv_id"))
    keep = first.join(inner, ["n", "h", "g"], "left_anti").select(F.col("conv_id").alias("kept"))
    return rows.join(keep, rows["conv_id"].eqNullSafe(keep["kept"]), "left_semi").select("conv_id", "at", "role", "text")


def rendered(turns: DataFrame, before: str = "<|im_start|>", between: str = "\n", after: str = "<|im_end|>\n", **names: str) -> DataFrame:
    """(conv_id, n_turns, chat): the maximal conversations, each turn as before + role + between + text + after.

    A mark inside a role or text gets a space after its first character, so that nobody's text can open or close a turn;
    marks with a space in them are refused. Rows that repeat are turns of their own. Texts may be of any length.
    """
    marks = (before.strip(), after.strip())
    if any(" " in m or len(m) < 2 for m in marks):
        raise ValueError("marks must have two characters at least and no space")

    def clean(name: str):
        value = F.coalesce(F.col(name), F.lit(""))
        for mark in marks:
            value = F.replace(value, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
        return value

    one = F.concat(F.lit(before), clean("role"), F.lit(between), clean("text"), F.lit(after))
    said = maximal(turns, **names).select("conv_id", F.struct("at", one.alias("one")).alias("said"))
    whole = said.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("said")).alias("said"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("said", lambda s: s["one"]), "").alias("chat"))


def rendered_sql() -> str:
    """The same for roles and texts without marks, in DuckDB's SQL: lists of turns compared, no hashes."""
    return """
    WITH r AS (SELECT conv_id, coalesce(role, chr(1)) AS k, coalesce(text, chr(1)) AS v, role, text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
    c AS (SELECT conv_id, count(*) AS n, list({k: k, v: v} ORDER BY pos) AS said, min(CASE WHEN pos = 1 THEN k || chr(2) || v END) AS head,
                 string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
          FROM r GROUP BY conv_id)
    SELECT conv_id, n AS n_turns, chat FROM c
    WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.head = c.head AND o.said[1:c.n] = c.said AND (o.n > c.n OR o.n = c.n AND o.conv_id < c.conv_id))"""
