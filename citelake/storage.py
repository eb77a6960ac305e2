"""Where intermediate tables go."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="citelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a
    local master has one of our own; a cluster has none, and this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or "file://" + _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table; the tables of an application are in one folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with a copy
    that survives the loss of any executor. It stays until ``discard``, or until its
    application's folder is deleted."""
    path = new_path(df.sparkSession, name)
    own = _OWNED.get()
    if own is not None:
        own.add(path)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.materialized_at = path
    return read


#: The tables of the step of ``only`` that is at work in this thread.
_OWNED: ContextVar[set[str] | None] = ContextVar("tables", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    own = _OWNED.get()
    if own is not None:
        own.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.materialized_at)


def only(spark: SparkSession, step: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``step`` returns and delete all other tables that ``step`` itself
    has written, also where it fails. Tables that other work writes meanwhile stay."""
    own: set[str] = set()
    before = _OWNED.set(own)
    kept = None
    try:
        kept = materialize(step(), name)
    finally:
        _OWNED.reset(before)
        for path in own - {kept.materialized_at if kept is not None else None}:
            _delete(spark, path)
    outer = _OWNED.get()
    if outer is not None:
        outer.add(kept.materialized_at)
    return kept


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver has it from: its sources
    go to the executors as one archive, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="citelake-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
