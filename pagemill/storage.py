"""Intermediate tables. They are written, not cached: what reads them has a short plan and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str = "audit") -> str:
    """A new folder of this application's own in ``spark.checkpoint.dir``; what ``discard`` leaves of it goes when the application's
    file system closes. Where that is unset, a temporary one, and only if all executors run in this process."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
    folder = f"{(base or f'file://{tempfile.mkdtemp(prefix="pagemill-")}').rstrip('/')}/pagemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ``scratch``, or a table in one; nothing may read it afterwards."""
    for path in [p for p in list(_tables) if f"{p}/".startswith(f"{folder.rstrip('/')}/")]:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    fs, at = _at(spark, folder)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


_SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_DEALT = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
_lock, _planned, _before = Lock(), Counter(), {}
_tables: dict[str, str] = {}  # by path, what catalogs know of it


@contextmanager
def dealt_already(spark: SparkSession) -> Iterator[None]:
    """Joins planned meanwhile leave rows where they are if both sides are dealt by some of the keys already."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _planned[session]:
            _before[session] = spark.conf.get(_SOME_KEYS)
            spark.conf.set(_SOME_KEYS, "false")
        _planned[session] += 1
    try:
        yield
    finally:
        with _lock:
            _planned[session] -= 1
            if not _planned[session]:
                spark.conf.set(_SOME_KEYS, _before.pop(session))


@contextmanager
def _dealt_into(spark: SparkSession, n: int) -> Iterator[None]:
    """What is planned meanwhile is shuffled into ``n`` partitions, small ones as well: what is made of the rows may be large."""
    before = {k: spark.conf.get(k, None) for k in _DEALT}
    try:
        for k, v in zip(_DEALT, (n, "false"), strict=True):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as ``folder``/``name`` and read again."""
    path = f"{folder.rstrip('/')}/{name}"
    with dealt_already(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, folder: str, name: str, buckets: int, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``staged`` in ``buckets`` by ``keys``, and in folders ``by`` those columns. What windows, groups or joins such tables by their keys, or
    by more columns, shuffles nothing. ``df`` should be dealt by ``keys`` into as many partitions."""
    spark, table = df.sparkSession, f"pagemill_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{folder.rstrip('/')}/{name}").bucketBy(buckets, *keys)
    with dealt_already(spark), _dealt_into(spark, buckets):
        (writer.partitionBy(*by) if by else writer).saveAsTable(table)
    _tables[f"{folder.rstrip('/')}/{name}"] = table
    return spark.table(table)


def together(tables: list[tuple[str, DataFrame | Callable[[], DataFrame]]], folder: str, at_once: int = 8) -> dict[str, DataFrame]:
    """Independent tables (name, rows or what makes them), ``staged`` with ``at_once`` of them under way at a time: while one is planned, others run."""
    if len({name for name, _ in tables}) < len(tables):
        raise ValueError("tables need names of their own")
    with ThreadPoolExecutor(at_once) as pool:
        rows = pool.map(lambda t: staged(t[1]() if callable(t[1]) else t[1], folder, t[0]), tables)
        return dict(zip([name for name, _ in tables], rows, strict=True))
