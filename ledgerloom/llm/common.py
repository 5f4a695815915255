"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
TRIMMED = " \t\n\x0b\x0c\r"


def quoted(name: str) -> str:
    """A column name that may hold dots, as Spark resolves it."""
    return "`" + name.replace("`", "``") + "`"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text) and nothing else, so that further columns can't clash; a null text is empty."""
    return docs.select(
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where it is unset and Spark is this process alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there and no executor holds it.

    files: in at most so many tasks and files, for results that are small beside the number of partitions. The table
    stays until dropped() or the end of a scratch() around this.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom-{what}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    made(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


#: The scratch() calls in force, innermost last, each with the paths made within.
_SCRATCH: list[list[str]] = []


def made(path: str) -> str:
    """Let the scratch() around this take the path away."""
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Take away the table of a DataFrame that stored() gave; nothing may read it afterwards."""
    removed(df.sparkSession, df._ledgerloom_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Take away, at the end, the tables that are stored within. Results must be written before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        removed(spark, *_SCRATCH.pop())


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Take away the shuffle files of each action within when it ends, so that those of many don't add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def trim() -> None:
    """Give memory that this worker has freed back to the system; Spark keeps its workers."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shares(amount: float, size: float, least: int = 1) -> int:
    """How many shares of about `size` make up `amount`."""
    return max(least, math.ceil((amount or 0) / size))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, wherever the optimizer moves the expression to."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each of values, `add` over all before it, from `zero`; add must not care how its steps are grouped.

    Built-in functions can't append to an array without copying it. So the values are cut into as many blocks as a
    block has values, and n values cost about n to the power 1.5.
    """
    before = lambda xs, by: F.aggregate(xs, F.struct(zero.alias("sum"), F.array().cast("array<long>").alias("out")), lambda acc, x: F.struct(add(acc["sum"], by(x)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))
    size = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))

    def blocks(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(xs, k * size + 1, size))
        return let(F.transform(cut, lambda block: before(block, lambda x: x)), lambda done: let(before(done, lambda d: d["sum"])["out"], lambda start: joined(done, start)))

    def joined(done: Column, start: Column) -> Column:
        return F.flatten(F.transform(done, _pair(lambda d, i: F.transform(d["out"], lambda x: add(F.get(start, i), x)))))

    return let(values, blocks)


def _pair(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, i: f(x, i)


def words_of(text):
    """array<string> of the words between SPACE runs, in built-in functions; [] for none."""
    body = F.btrim(text, F.lit(TRIMMED))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))
