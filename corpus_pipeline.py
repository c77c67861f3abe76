"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each one works on all that its predecessor kept. All but the last
return the columns of ``documents``. Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with names of ours
have the results that the operators' own docstrings state; each stage says what that means for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.packing import pack
from pagemill.llm.quality import keep_good
from pagemill.llm.secret_scan import redact
from pagemill.llm.shared import discard, only_results, table, written
from pagemill.llm.simhash import drop_near_copies
from pagemill.llm.winnowing import drop_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null, empty and very short texts among them; repeated rows are judged each."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: that with the smallest doc_id, nulls last; of repeated rows one stays.
    Null and empty texts are one group."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and ``n_chars`` follows the text. Null texts stay null."""
    cleaned = redact(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is one end id."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express fingerprints, tokenizers or decoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of earlier ones are deleted as soon as the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with only_results(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
