"""Helpers shared by the corpus operators: name clashes, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other code point stays. Texts of ASCII alone take the engine's faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in for it in local mode only; on a cluster a missing setting is an error,
    since a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="quartzgrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and return the table read back.

    The files outlive any executor. They are removed by :func:`discard`, at the end of :func:`scratch` (unless
    ``keep``), by :func:`clean_up`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quartzgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    if keep:
        _kept.add(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


_tables: dict[str, list[str]] = {}
_kept: set[str] = set()
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`durable` returned and that nothing reads any more, before their block ends. What was
    made of them must be durable itself. Other tables, those of a caller among them, are left alone."""
    for table in tables:
        path = _path_of.pop(table, None)
        own = _tables.get(table.sparkSession.sparkContext.applicationId, [])
        if path in own:
            own.remove(path)
            _kept.discard(path)
            _remove(table.sparkSession, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that :func:`durable` writes inside, but for those to ``keep``, when the block ends.

    What is returned from the block may read kept tables and the input only, as it is worked out later, and again
    where an executor is lost. An inner block keeps its tables for the outer one, which removes those that it
    doesn't keep itself.
    """
    own = spark.sparkContext.applicationId
    before, outer = set(_tables.get(own, [])), set(_kept)
    try:
        yield
    finally:
        tables = _tables.get(own, [])
        gone = [path for path in tables if path not in before and path not in _kept]
        tables[:] = [path for path in tables if path in before or path in _kept]
        _kept.intersection_update(outer)
        _remove(spark, gone)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that :func:`durable` has written for this application. Results that read them must have
    been written elsewhere before."""
    _remove(spark, _tables.pop(spark.sparkContext.applicationId, []))


def numbered(df: DataFrame, row: str | None, **columns: Column) -> DataFrame:
    """``row`` and the given columns of ``df``, with row numbers that hold however often the result is read.

    Files are split by the number of cores, anew for each action, so numbers that are drawn again after an executor
    is lost can belong to other rows. Numbers and columns are therefore stored together, once. With ``row``, a column
    of unique numbers in a table that is stored already, nothing is written.
    """
    own = [c.alias(name) for name, c in columns.items()]
    if row is not None:
        return df.select(F.col(row).alias("row"), *own)
    return durable(df.select(F.monotonically_increasing_id().alias("row"), *own))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows by count, else unchanged (a shuffled join).

    ``df`` should be durable, as it is counted and then read again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that none needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quartzgrid-")) / "quartzgrid_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
