"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TRIMMED, let, quoted, words_of

#: Frequent short words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from".split(),
    "es": "de la que el en y los las se del un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que pour est par dans qui au sur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}

SYMBOLS = "#*$%&|<>"

#: (ratio, smallest value that passes, largest value that passes); a document fails by any of them.
#: Values at a threshold pass. A ratio whose denominator is zero is null and passes.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
]


def assessed(text: Column, rules: list, stop_words: list[str]) -> Column:
    """The struct of counts, ratios and verdicts of one text, as a single expression without user functions."""
    blank = F.lit(TRIMMED)
    full_lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, blank) != "")

    def windows(words: Column) -> Column:
        """All windows of three words with their place, sorted: equal ones become neighbours."""
        n = F.size(words) - 2
        part = lambda first: F.slice(words, F.lit(first), n)
        zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(0), n - 1).alias("at"))
        return F.when(n >= 2, F.sort_array(zipped))

    def repeated(sorted_: Column) -> Column:
        """The places of windows that have an equal neighbour."""

        def equal(x: Column, i: Column) -> Column:
            y = F.get(sorted_, i)
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        found = F.filter(sorted_, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
        return F.coalesce(F.transform(found, lambda x: x["at"]), F.array().cast("array<int>"))

    def covered(places: Column) -> Column:
        one, two = F.transform(places, lambda p: p + 1), F.transform(places, lambda p: p + 2)
        return F.size(F.array_distinct(F.concat(places, one, two)))

    def counted(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(windows(words), lambda s: let(repeated(s), covered)),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])

    def judged(c: Column) -> Column:
        over = lambda a, b: F.when(c[b] > 0, c[a] / c[b])
        ratios = {
            "mean_word_length": over("word_chars", "n_words"),
            "symbol_ratio": over("n_symbols", "n_words"),
            "stop_word_ratio": over("n_stop_words", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
        }
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        broken = reduce(lambda a, b: a | b, [_breaks(ratios[name], low, high) for name, low, high in rules], F.lit(False))
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
        return F.struct(*[c[k].alias(k) for k in names], *[v.alias(k) for k, v in ratios.items()], failed.alias("base_failed"), (~failed & ~broken).alias("kept"))

    return let(words_of(text), lambda words: let(full_lines, lambda lines: let(counted(words, lines), judged)))


def measured(docs: DataFrame, rules: list | None = None, stop_words: dict | None = None, text_col: str = "text", to: str = "quality") -> DataFrame:
    """docs with one more column, named `to`: a struct of counts, ratios, base_failed and kept.

    A null text has no words. base_failed: under 50 words, or over half of them in three-word windows that the text
    repeats. kept: not base_failed and no rule of the table broken. Rows and other columns of docs stay as they are;
    an existing column of the name `to` is replaced. Every row is judged alone, so ties and repeated rows need no rule.
    Texts may be of any length.
    """
    every = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.withColumn(to, assessed(text, rules or RULES, every))


def _breaks(ratio: Column, low: float | None, high: float | None) -> Column:
    tests = ([ratio < low] if low is not None else []) + ([ratio > high] if high is not None else [])
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts of the contract, base_failed, kept), one row per row of docs."""
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    q = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measured(base).select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in q])


def verdicts_sql() -> str:
    """The same in DuckDB's SQL, by sets of rows instead of arrays where that is an independent way."""
    stop = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
    w AS (SELECT r, t, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    x AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
    g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
    m AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM g WHERE three IS NOT NULL),
    c AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM m WHERE n > 1) GROUP BY r),
    l AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    s AS (SELECT r, count(*) AS n_stop FROM x WHERE lower(word) IN ({stop}) GROUP BY r),
    a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(lines, 0) AS lines
          FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
           AND (lines = 0 OR n_dup_lines / lines <= 0.5) AS kept
    FROM b"""
