"""The command line: one document from format to format, and the reports over the mappings.

    python -m ledgerloom.cli <INPUT> <TARGET> [--from <SOURCE>] [--out <FILE>]
    python -m ledgerloom.cli --analyze [SOURCE] | --keys [FORMAT] | --list | --help

INPUT is a file, or - for standard input. Exit codes: 0; 64 for wrong arguments and for formats that are unknown or
can't be told from the document; 65 for documents that can't be read or have errors; 74 for files that can't be read or
written. For many documents use Engine: this starts Spark for one.
"""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO, NoReturn, TextIO

from pyspark.sql import SparkSession

from ledgerloom.engine import Engine
from ledgerloom.operators import reports
from ledgerloom.plans.mapping import Compiled

#: The exit codes.
USAGE_ERROR, DATA_ERROR, FILE_ERROR = 64, 65, 74


class Failure(Exception):
    def __init__(self, code: int, text: str) -> None:
        super().__init__(text)
        self.code = code


class Arguments(ArgumentParser):
    """The arguments, as told above; what is wrong with them is a Failure."""

    def __init__(self) -> None:
        super().__init__(add_help=False, allow_abbrev=False)
        self.add_argument("words", nargs="*")
        for name in ("from", "out"):
            self.add_argument(f"--{name}")
        for name in ("analyze", "keys", "list"):
            self.add_argument(f"--{name}", action="store_true")
        self.add_argument("-h", "--help", action="store_true")

    def error(self, message: str) -> NoReturn:
        raise Failure(USAGE_ERROR, f"{message}; see --help")


def asked(args: list[str]) -> dict:
    """The command, its words, and the values of --from and --out."""
    given = vars(Arguments().parse_intermixed_args(args))
    reports_of = [k for k in ("analyze", "keys") if given[k]]
    command = "help" if given["help"] else "list" if given["list"] else reports_of[0] if reports_of else "transform" if given["words"] else "help"
    most = {"analyze": 1, "keys": 1, "transform": 2}.get(command)
    if most and (len(reports_of) > 1 or len(given["words"]) > most or (command == "transform" and len(given["words"]) < most)):
        raise Failure(USAGE_ERROR, "one report at a time, of one format at most; a conversion needs an input and a target; see --help")
    return {"command": command, "words": given["words"], "source": given["from"], "out": given["out"]}


def known(c: Compiled, name: str) -> str:
    try:
        return c[name].id
    except KeyError:
        raise Failure(USAGE_ERROR, f"there is no format {name}; there are: {' '.join(s.id for s in c.spokes)}") from None


def transformed(call: dict, engine: Engine, spark: Callable[[], SparkSession], stdin: BinaryIO) -> tuple[str, list]:
    """The new document and its diagnostics."""
    name, target = call["words"]
    try:
        body = stdin.read() if name == "-" else Path(name).read_bytes()
    except OSError as e:
        raise Failure(FILE_ERROR, f"can't read {name}: {e}") from e
    to, source = known(engine.compiled, target), call["source"] and known(engine.compiled, call["source"])
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Failure(DATA_ERROR, f"{name} is not UTF-8: {e}") from e
    doc = spark().createDataFrame([(text,)], "xml string")
    source = source or engine.detect(doc).first()["spoke"]
    if source in ("ambiguous", "unknown"):
        raise Failure(USAGE_ERROR, f"the format of {name} is {source}: name it by --from")
    r = engine.transform(doc, source, to).first()
    if r["status"] != "ok":
        raise Failure(DATA_ERROR, f"{name} is {r['status']}")
    if not r["accepted"] or r["xml_out"] is None:
        raise Failure(DATA_ERROR, told(r["diagnostics"]).rstrip())
    return r["xml_out"].rstrip("\n") + "\n", r["diagnostics"]


def told(diagnostics: list) -> str:
    return "".join(f"{d['severity']} [{d['code']}] {d['source_node']}: {d['message']}\n" for d in diagnostics)


def run(args: list[str], stdin: BinaryIO, stdout: TextIO, stderr: TextIO, spark: Callable[[], SparkSession], engine: Engine | None = None) -> int:
    """Do what the arguments ask for; the exit code. spark() is only called where rows are needed."""
    try:
        call = asked(args)
        engine = engine or Engine()
        c = engine.compiled
        names = "".join(f"    {s.id}\n" for s in c.spokes)
        of = (call["source"] or next(iter(call["words"]), None)) if call["command"] in ("analyze", "keys") else None
        if call["command"] == "transform":
            xml, notes = transformed(call, engine, spark, stdin)
            try:
                Path(call["out"]).write_text(xml, encoding="utf-8", newline="") if call["out"] else stdout.write(xml)
            except OSError as e:
                raise Failure(FILE_ERROR, f"can't write {call['out']}: {e}") from e
            stderr.write(told(notes))
        elif call["command"] == "analyze":
            stdout.write(reports.conversion_table(spark(), c, of and known(c, of)))
        elif call["command"] == "keys":
            stdout.write(reports.spoke_key_text(spark(), c, known(c, of)) if of else reports.key_table(spark(), c))
        else:
            stdout.write((f"{__doc__}\nFormats:\n" if call["command"] == "help" else "") + names)
    except Failure as e:
        stderr.write(f"{e}\n")
        return e.code
    return 0


def session() -> SparkSession:
    quiet = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    quiet.sparkContext.setLogLevel("ERROR")
    return quiet


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdin.buffer, sys.stdout, sys.stderr, session))
