"""Audits of packages as they arrive in a folder: each document once, and each batch's results whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import audit
from ..plans.rules import EXPECTED
from ..sources import scan
from ..sources.parts import parts_of
from ..storage import discard, exists, scratch

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: The tables that a stream writes; a batch is complete once it has a part of the last one.
TABLES = ("findings", "rule_results", "quarantine", "seen")


def seen(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(doc_id, path, batch) of the files of all complete batches, or of those before a number."""
    at = f"{out.rstrip('/')}/seen"
    rows = spark.read.schema("doc_id string, path string, batch long").parquet(at) if exists(spark, at) else spark.createDataFrame([], "doc_id string, path string, batch long")
    return rows if before is None else rows.filter(F.col("batch") < before)


def results(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of all complete batches; what a failed batch left is no part of it until that batch has run again."""
    rows = spark.read.parquet(f"{out.rstrip('/')}/{name}")
    return rows.join(seen(spark, out).select("batch").distinct(), "batch", "left_semi")


def audit_batch(files: DataFrame, number: int, out: str, rules: DataFrame | None = None, expected: dict = EXPECTED) -> None:
    """Audit those of ``files`` (path, content) whose bytes no earlier batch had, and write batch ``number``'s part of each table.

    A batch that runs again reads the same state, for it looks at earlier batches only, and writes over what it wrote before. ``seen`` comes
    last and lists all files of the batch. The batch's intermediate tables are deleted at its end."""
    spark, folder = files.sparkSession, scratch(files.sparkSession, "inbox")
    place = lambda name: f"{out.rstrip('/')}/{name}/batch={number}"
    try:
        named = files.select("path", "content", F.sha2("content", 256).alias("doc_id"))
        new = named.join(seen(spark, out, number).select("doc_id").distinct(), "doc_id", "left_anti")
        nodes = scan.Nodes(parts_of(new), f"{folder}/scan")
        done = audit(spark, scan.documents(nodes), rules, expected, f"{folder}/audit")
        for name, rows in (("findings", done.findings), ("rule_results", done.rule_results), ("quarantine", done.quarantine)):
            rows.write.mode("overwrite").parquet(place(name))
        named.select("doc_id", "path").write.mode("overwrite").parquet(place("seen"))
    finally:
        discard(spark, folder)


def watch(spark: SparkSession, inbox: str, checkpoint: str, out: str, files_per_batch: int = 1000, rules: DataFrame | None = None, expected: dict = EXPECTED) -> StreamingQuery:
    """Audit the ``*.docx`` files that arrive under ``inbox`` into the tables below ``out``; see ``audit_batch`` and ``results``.

    The stream's checkpoint gives each batch a number and the same files if it runs again; the tables' folders carry that number. So a result
    is there once, whenever a batch fails."""
    arriving = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_batch).load(inbox)
    return arriving.writeStream.foreachBatch(lambda frame, number: audit_batch(frame, number, out, rules, expected)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
