"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import gc
import sys
import types

from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.columns import own_names
from evigraph.functions.text import let

__all__ = ["SPACES", "WORD", "checkpointed", "identity", "let", "own_names", "release_shuffles", "row_key", "ship", "small", "worker_store"]

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, for translate().
SPACES = " \t\n\x0b\x0c\r"


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """The table marked for broadcast if it is checked to have at most so many rows (narrow ones, here); else as it is."""
    return F.broadcast(table) if table.count() <= most else table


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more, which it does after garbage collections.

    Only a driver that runs the JVM beside it can ask for one; elsewhere Spark's own interval holds.
    """
    gc.collect()
    with contextlib.suppress(PySparkException, AttributeError):
        spark.sparkContext._jvm.System.gc()


def ship(name: str) -> None:
    """Let Python workers receive the functions of module `name` by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_store(name: str) -> dict:
    """A dict of the process, for what tasks may share: their functions, and all they refer to, arrive anew with each task."""
    name = f"_evigraph_{name}"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


ship(__name__)


def identity(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text for ids that several texts share."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash")]


def row_key(*columns: str) -> list[Column]:
    """Two longs, never null, that are equal for rows alike in all these columns, nulls included."""
    whole = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(k), *whole) for k in (1, 2)]
