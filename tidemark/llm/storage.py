"""Where the operators of this package keep what they write between stages, and how their code and memory go to and fro."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.code import ship
from tidemark.sources.scratch import path as scratch_path
from tidemark.sources.scratch import written

__all__ = ["give_back", "map_arrow", "partitions", "scratch_path", "scratch_table", "written"]

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # no glibc here: its allocator needs no trimming
    _libc = None


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh table name; the table is dropped when the Python process ends."""
    table = f"tidemark_{name}_{uuid.uuid4().hex}"
    atexit.register(_drop, spark, table)
    return table


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def give_back() -> None:
    """Return freed memory of this process to the system: large arrays of many sizes otherwise stay with the allocator."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What empties the caches of a worker, and the module whose work they serve.
_caches: list[Callable[[], None]] = []
_served: list[str] = [""]


def cache(empty: Callable[[], None]) -> None:
    """Have `empty` called when a worker turns to another module's work."""
    _caches.append(empty)


def serve(module: str) -> None:
    """Spark hands a worker from stage to stage and from job to job: caches of other work would stay beside the present one."""
    if _served[0] != module:
        _served[0] = module
        for empty in _caches:
            empty()
        give_back()


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema), with this package sent to the executors, which may not have it installed. A worker gives memory back after each task, and its caches when another module's tasks come."""
    ship(df.sparkSession)
    module = f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(module)
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)
