"""Shared storage: rows written once to the folder that driver and executors share.

What is written lives in the folder of the scope that is open, and goes when the scope closes, on
failure too. Without a scope it stays until the folder is emptied.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession



@dataclass
class _Scope:
    folder: str
    stages: dict[tuple, DataFrame]


# The scopes that are open, outermost first.
_scopes: list[_Scope] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``.

    Where none is set, a session on one machine takes a temporary folder; a cluster has none that
    all its machines see, so there the setting is asked for before any work is done.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_configured(spark))
    return context.getCheckpointDir()


def _configured(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="chronoloom-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that its lineage ends there: a lost executor
    costs a read, and several readers cost one computation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it lies on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Storage for one unit of work: what is stored inside is deleted at the end.

    The results of the work are to be written (or collected) inside, as they read what is stored.
    Scopes may be nested; each deletes its own.
    """
    context = spark.sparkContext
    before = _scopes[-1].folder if _scopes else shared_folder(spark).rsplit("/", 1)[0]
    # Spark names a new folder inside the one it is given.
    context.setCheckpointDir(before)
    _scopes.append(_Scope(context.getCheckpointDir(), {}))
    try:
        yield _scopes[-1].folder
    finally:
        remove(spark, _scopes.pop().folder)
        context.setCheckpointDir(before)


def shared_stage(spark: SparkSession, name: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name``, written when the open scope first asks for it and read from there after;
    without a scope simply built."""
    if not _scopes:
        return build()
    for opened in reversed(_scopes):
        if name in opened.stages:
            return opened.stages[name]
    return _scopes[-1].stages.setdefault(name, stored(build()))
