"""The library's front: documents in, canonical records and other formats out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import diagnostic_line
from ledgerloom.operators.detect import detected
from ledgerloom.operators.mixed import flat_mixed
from ledgerloom.operators.reader import NOTES, STATUS, VALUE, flat, quoted, to_fields, to_hub, to_items
from ledgerloom.operators.writer import from_hub, labels, written
from ledgerloom.plans.mapping import HERE, compile_all


HUB, XML, TOLD = (f"_ledgerloom_{x}" for x in ("hub", "xml", "told"))


def has_error(diagnostics: Column) -> Column:
    return F.exists(diagnostics, lambda d: d["severity"] == "error")


class Engine:
    """Formats by name:version or by name; nothing is executed until a result is asked for, and nothing is shuffled.

    With `keys`, documents are only parsed as far as these canonical keys and the required ones need; the smaller the
    set, the smaller the plan and the work for each document.
    """

    def __init__(self, folder: Path | str = HERE, keys: set[str] | None = None) -> None:
        self.compiled = compile_all(folder)
        if keys:
            self.compiled.spokes = [s.only(keys) for s in self.compiled.spokes]
            left = {label for s in self.compiled.spokes for label in s.covered()}
            self.compiled.fields = {k: v for k, v in self.compiled.fields.items() if k in left}

    def detect(self, docs: DataFrame, xml: str = "xml") -> DataFrame:
        return docs.withColumn("spoke", detected(F.col(xml), self.compiled.spokes))

    def to_hub(self, docs: DataFrame, spoke: str, xml: str = "xml", strict: bool = True) -> DataFrame:
        return to_hub(docs, self.compiled[spoke], xml, strict)

    def fields(self, docs: DataFrame, spoke: str, keys: list[str] | None = None, xml: str = "xml", strict: bool = True, parse: set[str] | None = None) -> DataFrame:
        """The record's fields as columns, see to_fields. parse: keys that documents are parsed for, instead of all; the
        status and the diagnostics then speak of these only."""
        return to_fields(docs, self.compiled[spoke].only(parse, required=False) if parse else self.compiled[spoke], keys, xml, strict)

    def items(self, docs: DataFrame, spoke: str, collection: str, keys: list[str] | None = None, xml: str = "xml", strict: bool = True) -> DataFrame:
        """A row per element of a collection, see to_items."""
        return to_items(docs, self.compiled[spoke], collection, keys, xml, strict)

    def from_hub(self, docs: DataFrame, spoke: str) -> DataFrame:
        return from_hub(docs, self.compiled[spoke])

    def transform(self, docs: DataFrame, source: str, target: str, xml: str = "xml", strict: bool = True) -> DataFrame:
        """docs with hub, status, xml_out, diagnostics (reading before writing), and accepted: whether no error was told."""
        return self._written(*flat(docs, self.compiled[source], xml, strict), target, docs.columns)

    def transform_mixed(self, docs: DataFrame, target: str, xml: str = "xml", strict: bool = True) -> DataFrame:
        """Documents of any format to one, in one pass; those without a format are left to detect(). As transform, with spoke."""
        found = self.detect(docs, xml)
        read, fields = flat_mixed(found, self.compiled, xml, strict)
        return self._written(read.where(F.col(STATUS).isNotNull()), fields, target, found.columns)

    def _written(self, read: DataFrame, fields: list[str], target: str, names: list[str]) -> DataFrame:
        hub, ok = {f: F.col(VALUE + f) for f in fields}, F.col(STATUS) == "ok"
        record = F.when(ok, F.struct(*[c.alias(f) for f, c in hub.items()])).alias(HUB)
        names = [c for c in names if c not in {"hub", "diagnostics", "status", "xml_out", "accepted"}]
        columns = labels(read.select(record).schema[HUB].dataType)
        out = written(read.select("*", record), self.compiled[target], hub, columns, ok, [*names, HUB, STATUS, NOTES], XML, TOLD)
        notes = F.concat(NOTES, TOLD).alias("diagnostics")
        out = out.select(*[F.col(quoted(c)) for c in names], F.col(HUB).alias("hub"), notes, F.col(STATUS).alias("status"), F.col(XML).alias("xml_out"))
        return out.withColumn("accepted", (F.col("status") == "ok") & ~has_error(F.col("diagnostics")))

    def replies(self, docs: DataFrame, target: str, source: str | None = None, xml: str = "xml") -> DataFrame:
        """docs with http_status, body and warnings: what a service would answer to each document.

        200 and the new document, with its diagnostics in one line; 400 where the format can't be told or the document
        can't be read; 422 and the diagnostics where there are errors. Without a source, formats are detected.
        """
        notes = lambda sep: F.array_join(F.transform("diagnostics", diagnostic_line), sep)
        names = [F.col(quoted(c)) for c in docs.columns]
        if source:
            done, lost = self.transform(docs, source, target, xml), F.lit(None).cast("string")
        else:
            found = self.detect(docs, xml)
            done = self._written(*flat_mixed(found, self.compiled, xml), target, found.columns)
            lost = F.when(F.col("spoke") == "ambiguous", "source format is ambiguous").when(F.col("spoke") == "unknown", "could not detect the source format")
        accepted, read = F.coalesce("accepted", F.lit(False)), F.coalesce(F.col("status") == "ok", F.lit(False))
        failed = F.concat(F.lit("transformation failed with errors:\n"), notes("\n"))
        unread = F.coalesce(lost, F.concat(F.lit("source deserialization failed: the document is "), F.col("status")))
        status = F.when(accepted, 200).when(read, 422).otherwise(400)
        body = F.when(accepted, F.col("xml_out")).when(read, failed).otherwise(unread)
        return done.select(*names, status.alias("http_status"), body.alias("body"), F.when(accepted, notes("; ")).otherwise("").alias("warnings"))
