"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. Each word is hashed once to a long; a gram is the
hash of ``GRAM`` consecutive word hashes, and a window of ``WINDOW`` words keeps the least hash of its grams as its fingerprint, so
two equal windows always share it, and a span of ``WINDOW`` or more words that a document shares with an item is never missed. An item
of fewer words is one window with the hash of all its words; only lengths that occur among the items are looked for.

1. One pass over the documents: word count, and those windows whose fingerprint's place in a bitmap of the items' fingerprints
   is set, with their words. Grams are tested first, so windows are formed only around a gram that an item may have selected. The
   bitmap has ``BITS_EACH`` bits a fingerprint and ``MOST_BITS`` (2 MB) at most; beyond 131,072 fingerprints more windows pass for
   nothing (one in sixteen at a million), which costs time and disk and no result. No text is shuffled or read again.
2. The windows' fingerprints are joined with the items'.
3. Extension: windows with a matched fingerprint are compared word by word with the items' windows (an equi-join on the window's
   words). What is equal is an occurrence; occurrences that overlap or touch are one span of hit words.
4. A text's items are listed by way of the distinct sets of items that its windows belong to.

Everything is keyed by the row, so copies of a text, however many, are spread over all tasks. Joins are broadcast only where Spark
finds the written table below its size threshold. Nothing pairs documents with each other.

Defined cases: null texts have no words; null ``item_id`` counts for hits and is not listed; null ``doc_id`` stays null; repeated
rows are judged each; without items or documents nothing is contaminated; very long texts are taken whole, one row's words in memory;
other columns, whatever their names, are kept by ``drop_contaminated`` and ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, written

WINDOW, GRAM = 10, 5
#: Bits of the bitmap for each fingerprint of an item, and the fewest and most in all.
BITS_EACH, FEWEST_BITS, MOST_BITS = 128, 1 << 16, 1 << 24
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _GAP), ""), F.array().cast("array<string>"))


def _let(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once: Catalyst would copy a column's expression into a lambda that names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _run_hash(hs: Column, at: Column, size: int, *salt: Column) -> Column:
    """The hash of ``size`` word hashes from ``at`` on; arithmetic on longs."""
    return F.xxhash64(*salt, *[F.get(hs, at + k) for k in range(size)])


def _grams(hs: Column) -> Column:
    """Of each position; the last ``GRAM - 1`` are of runs that are too short and not to be used."""
    return F.transform(hs, lambda _, i: _run_hash(hs, i, GRAM))


def _least(g: Column, at: Column) -> Column:
    """The fingerprint of the window of ``WINDOW`` words at ``at``."""
    return F.array_min(F.slice(g, at + 1, WINDOW - GRAM + 1))


def _item_windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, size, window, fp): the items' windows as space-joined words, with their fingerprints."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    n, size = F.size("ws"), F.least(F.size("ws"), F.lit(WINDOW))
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(size.alias("size"), F.slice("ws", i + 1, size).alias("w")))
    wins = own.select("item_id", F.inline(runs)).distinct()
    short = F.expr("cast(null as bigint)")
    for s in range(WINDOW - 1, 0, -1):
        short = F.when(F.col("size") == s, _run_hash(F.col("hs"), F.lit(0), s, F.lit(s))).otherwise(short)
    wins = wins.withColumn("hs", _hashes(F.col("w"))).withColumn("long", _least(_grams(F.col("hs")), F.lit(0)))
    return wins.select("item_id", "size", F.array_join("w", " ").alias("window"), F.when(F.col("size") == WINDOW, F.col("long")).otherwise(short).alias("fp"))


def _bitmap_test(fps: DataFrame):
    """A test on a fingerprint: false only if ``fps`` doesn't hold it. It reads a constant array of longs."""
    bits, n = FEWEST_BITS, fps.count()
    while bits < MOST_BITS and bits < BITS_EACH * n:
        bits *= 2
    # At most bits / 64 rows.
    slot = F.shiftright(F.col("fp").bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    rows = fps.groupBy(slot.alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("v")).collect()
    held = {r.k: r.v for r in rows}
    longs = F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")

    def test(fp: Column) -> Column:
        word = F.get(longs, F.shiftright(fp.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
        return F.call_function("getbit", word, fp.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def _candidates(size: int, ws: Column, hs: Column, maybe) -> Column:
    """Of a text's windows of ``size`` words, those whose fingerprint passes: (at, size, fp, window)."""
    n = F.size(ws)
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def found(starts: Column, fp) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), fp(i).alias("fp"), F.array_join(F.slice(ws, i + 1, size), " ").alias("window")))

    if size < WINDOW:
        fp = lambda i: _run_hash(hs, i, size, F.lit(size))
        return found(F.filter(every, lambda i: (i + size <= n) & maybe(fp(i))), fp)

    def of(g: Column) -> Column:
        passed = F.filter(every, lambda i: (i + GRAM <= n) & maybe(F.get(g, i)))
        around = lambda p: F.filter(F.sequence(p - (WINDOW - GRAM), p), lambda i: (i >= 0) & (i + WINDOW <= n) & (_least(g, i) == F.get(g, p)))
        return found(F.array_distinct(F.flatten(F.transform(passed, around))), lambda i: _least(g, i))

    return _let(_grams(hs), of)


def _row_key(df: DataFrame) -> Column:
    return F.md5(F.concat_ws("\n", F.coalesce(df["doc_id"].cast("string"), F.lit("")), F.coalesce(df["text"], F.lit(""))))


def contamination(df: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, row_key (names id and text), n_words, n_hit, item_ids (sorted, as strings), against
    ``items`` (item_id, text)."""
    wins = written(_item_windows(items), "item-windows")
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW of them
    fps = written(wins.select("fp").distinct(), "item-fingerprints")
    maybe = _bitmap_test(fps)

    # Written once, so that a row's number stays.
    docs = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", _row_key(df).alias("row_key"), words(df["text"]).alias("ws"))
    own = _let(_hashes(F.col("ws")), lambda hs: F.concat(*[_candidates(s, F.col("ws"), hs, maybe) for s in sizes]))
    seen = written(docs.select("row", "doc_id", "row_key", F.size("ws").cast("long").alias("n_words"), own.alias("own")), "candidate-windows")

    matched = seen.select("row", F.inline("own")).join(fps, "fp", "left_semi")
    lists = wins.groupBy("size", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    lists = written(lists.withColumn("list", F.md5(F.array_join("item_ids", "\n"))), "item-lists")
    hits = written(matched.join(lists.select("size", "window", "list"), ["size", "window"]).select("row", "at", "size", "list"), "hits")

    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["at"] + x["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["end"], x["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    distinct = lists.groupBy("list").agg(F.first("item_ids").alias("item_ids"))
    listed = hits.select("row", "list").distinct().join(distinct, "list").select("row", F.explode("item_ids").alias("item_id"))
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    texts = spans.select("row", merged.alias("n_hit")).join(listed, "row", "left")
    out = seen.select("row", "doc_id", "row_key", "n_words").join(texts, "row", "left")
    return out.select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(df: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``df`` whose text holds no window of an item, with all columns."""
    (key,) = fresh(df, "row_key")
    found = contamination(df, items).filter("n_hit > 0").select(F.col("row_key").alias(key)).distinct()
    # The list grows with the corpus, so it is never broadcast.
    return df.withColumn(key, _row_key(df)).join(written(found, "contaminated").hint("merge"), key, "left_anti").select(*[f"`{c}`" for c in df.columns])


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hit AS (
  SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN listed USING (r)
"""
