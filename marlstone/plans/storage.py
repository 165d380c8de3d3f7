"""Tables written to the folder that driver and executors share.

A cut replaces a DataFrame's lineage by a written table, so a lost executor costs a re-read rather than a
recomputation of everything before it. The folder is the one the cluster names in ``spark.checkpoint.dir``.

Cuts are deleted by ``drop()``, at the end of the ``scope()`` they were made in, or else when the driver's Python ends.
A result that is read lazily from cuts must be written, or cut, before its scope ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_scopes: list[dict[str, Folder]] = [{}]


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. A local master, whose driver is its only executor, may go without one: it gets a
    temporary folder, made once per process."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="marlstone-")
    return f"file://{_own}"


class Folder:
    """A place of its own in the shared folder; ``drop()`` deletes what it holds."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/marlstone-{label}-{uuid.uuid4().hex}"
        self.scope = _scopes[-1]
        self.scope[self.path] = self

    def drop(self) -> None:
        self.scope.pop(self.path, None)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Cut(Folder):
    """A written table: ``df`` reads it back, ``drop()`` deletes its files once nothing needs them."""

    def __init__(self, df: DataFrame, label: str):
        super().__init__(df.sparkSession, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``Cut(df, label).df``, for tables that the result still reads lazily."""
    return Cut(df, label).df


def _drop_all(cuts: dict[str, Folder]) -> None:
    for c in list(cuts.values()):
        c.drop()


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Cuts made inside are deleted at its end."""
    _scopes.append({})
    try:
        yield
    finally:
        _drop_all(_scopes.pop())


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        for cuts in _scopes:
            _drop_all(cuts)
