"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are shuffled by a seeded hash and ranked within their source in that order; row r of a source with n rows gets the fraction
(2r - 1) / 2n, and all rows are sorted by it. Any stretch of that order holds each source in proportion, so cutting it into equal
counts gives shards that match the mixture; the law kept is ``rows``: counts at most one apart.

Both orders are found without a global sort or a task per source. Hash and fraction are evenly spread by construction, so equal
stretches of their range are buckets of bounded size; a rank is the count of rows in earlier buckets, from a small table of
counts, plus the row number inside the bucket. The number of buckets spreads the work and changes no place.

Defined cases: null texts have no bytes; null sources are one source; a null or repeated ``doc_id`` is told apart by the row's other
columns, which the shuffling hash and the order include (but maps); rows that are equal throughout take consecutive places; an empty
table gives no rows. Texts are hashed and never compared, whatever their length. Other columns are kept; one that has the name of an
output (``position``, or ``shard`` and ``slot``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, table, written

SHARDS, SEED, BUCKET_ROWS = 24, 6, 20_000


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def interleave(df: DataFrame, stratum: str, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``position`` (0 .. rows - 1), the row's place in the interleaved order of ``stratum``."""
    n = df.count()
    buckets = F.lit(max(1, -(-n // BUCKET_ROWS), min(n // 100, 4 * partitions(df.sparkSession))))
    told = F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)])
    # The caller's columns travel in one struct, so no name of theirs can meet one of ours.
    rows = df.select(F.struct("*").alias("row"), told.alias("told"), F.xxhash64(F.lit(seed), F.col(f"`{stratum}`")).alias("src"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("row").getField(key), "told"))
    rows = rows.withColumn("b", F.floor((F.col("h") / 2.0**64 + 0.5) * buckets))
    counts = rows.groupBy("src", "b").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("src")
    counts = counts.select("src", "b", (F.sum("n").over(own.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("of"))
    within = F.row_number().over(W.partitionBy("src", "b").orderBy("h", "told"))
    ranked = rows.withColumn("r", within).join(counts, ["src", "b"])
    ranked = ranked.withColumn("f", (2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("of")))
    ranked = written(ranked.withColumn("fb", F.floor(F.col("f") * buckets)).select("row", "src", "h", "told", "f", "fb"), "ranked")
    # A row for each bucket of BUCKET_ROWS rows: few, and counted before the shuffle.
    starts = ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("fb", (F.sum("n").over(W.orderBy("fb")) - F.col("n")).alias("first"))
    place = F.row_number().over(W.partitionBy("fb").orderBy("f", "src", "h", "told"))
    placed = ranked.withColumn("p", place).join(starts, "fb").select("row", (F.col("first") + F.col("p") - 1).alias("p"))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != "position"], F.col("p").alias("position"))


def stratified_shards(df: DataFrame, shards: int = SHARDS, stratum: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards - 1) and ``slot``, the row's place in its shard."""
    n = df.count()
    placed = interleave(df.select(F.struct("*").alias("row"), F.col(f"`{stratum}`").alias("src"), F.col(f"`{key}`").alias("key")), "src", "key", seed)
    shard = F.expr(f"position * {shards} div {max(n, 1)}")
    placed = placed.withColumn("s", shard).withColumn("slot", F.col("position") - F.expr(f"(s * {n} + {shards - 1}) div {shards}"))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, F.col("s").cast("int").alias("shard"), "slot")


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = written(slim, "sizes")
    placed = stratified_shards(slim)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
