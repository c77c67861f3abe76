"""Files by name: each row of (target, content) becomes one file, and all rows of a table do or none."""

from __future__ import annotations

import os.path
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .named import NAME, NamedFiles


def located(path: Column) -> Column:
    """Paths of one file in one form: local ones as file:///..."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^/", "file:///")


def target(path: Column, root: str, folder: str, suffix: str, kind: str = ".docx") -> Column:
    """Where the product of ``path`` goes: ``folder``, with the same folders below it as below ``root``; ``suffix`` and ``kind`` follow the stem."""
    own, base = located(path), located(F.lit(root.rstrip("/")))
    below = F.when(F.startswith(own, F.concat(base, F.lit("/"))), F.substr(own, F.length(base) + 2)).otherwise(F.element_at(F.split(own, "/"), -1))
    return F.concat(located(F.lit(folder.rstrip("/"))), F.lit("/"), F.regexp_replace(below, r"(?i)\.docx$", ""), F.lit(suffix + kind))


def _common_folder(first: str, last: str) -> str:
    """The folder that all names between two (in their order) lie in."""
    return os.path.commonprefix([first, last]).rpartition("/")[0]


def write_files(files: DataFrame, sources: DataFrame) -> int:
    """Write ``files`` (target, content) and give their number: all of them, or none if the job fails (see ``named``). Refused, before anything
    is written: two rows of one target, and a target that is a file of ``sources`` (path). An empty table writes nothing."""
    spark = files.sparkSession
    targets = files.select(located(F.col("target")).alias("target"))
    if twice := targets.groupBy("target").count().filter("count > 1").limit(3).collect():
        raise ValueError(f"more than one file would be {[r.target for r in twice]}")
    if own := targets.join(sources.select(located(F.col("path")).alias("target")), "target", "left_semi").limit(3).collect():
        raise ValueError(f"a source would be overwritten: {[r.target for r in own]}")
    first, last, n = targets.agg(F.min("target"), F.max("target"), F.count("target")).first()
    if n:
        spark.dataSource.register(NamedFiles)
        staging = f"{_common_folder(first, last)}/.pagemill-{uuid.uuid4().hex}"
        files.select(located(F.col("target")).alias("target"), "content").write.format(NAME).mode("append").option("staging", staging).save()
    return n
