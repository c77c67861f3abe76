"""The folder that driver and executors share, and tables written there to cut lineage.

What an operator writes lies under ``pagemill/<application>`` in that folder. Tables that no result reads any more are dropped by
``discard``; the rest goes when the application's file system closes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"

_folders: dict[tuple[str, str], str] = {}
_open_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own in ``spark.checkpoint.dir``. Where that is unset, a temporary one, and only if all
    executors run in this process; elsewhere they would each write to their own disk, so that is an error."""
    base, app = spark.conf.get(KEY, None) or "", spark.sparkContext.applicationId
    if (app, base) not in _folders:
        top = base
        if not top:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError(f"{KEY} is not set, and {master} needs a folder that all executors share")
            top = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        folder = f"{top.rstrip('/')}/pagemill/{app}"
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders[app, base] = folder
    return _folders[app, base]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes tables that ``written`` returned; nothing may read them afterwards."""
    for df in stored:
        fs, at = _file_system(df.sparkSession, df.stored_at)
        fs.delete(at, True)


@contextmanager
def only_results(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was written inside it, save for the written tables that were put on the list."""
    made, keep = [], []
    _open_scopes.append(made)
    try:
        yield keep
    finally:
        _open_scopes.remove(made)
        for path in set(made) - {df.stored_at for df in keep}:
            fs, at = _file_system(spark, path)
            fs.delete(at, True)


def partitions(spark: SparkSession, rows: int = 0, rows_each: int = 1) -> int:
    """The session's number of shuffle partitions, or more if each would get over ``rows_each`` of ``rows``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed so that ``df`` has no column of any of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
