"""Fill-in-middle: documents cut at token boundaries and put together in another order, with an index of distinct texts.

Each task first brings equal texts of a batch together, by content, as one row with the ids that have it. These rows are dealt by a
hash of the text and sorted, so that equal texts of all tasks meet; texts of one hash are compared, never taken for equal. Each distinct
text's token boundaries are found once and kept as an Elias-Fano list: low bits packed, high bits in unary, under three bits a token
in prose. The ids join their text's list there, and a document's two seeded cuts are two selections from it. A text moves once,
however many documents have it.

A text with many copies in one batch is dealt by the batch as well, so that no task gets all copies of a hot text; such a text is
indexed again for each batch that is full of it.

Defined cases: null text is empty, and plain; a null ``doc_id`` stays null and has an empty seed; repeated rows are cut each, and alike; an
empty table gives no rows; a text of any length is cut whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_PLAIN_FROM, _SPM_BELOW = 90, 20  # of a hundred
_HOT = 8  # copies in a batch from which a text is dealt by the batch too
_CHARS = 1 << 22  # of a batch of results


def boundaries(text: str) -> np.ndarray:
    """Where the tokens of ``text`` end, in code points: runs of ASCII letters, and each other code point."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small = codes | 32
    letter = (small >= 97) & (small <= 122) & (codes < 128)
    ends = np.ones(len(codes), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(ends) + 1


class EliasFano:
    """A rising list of whole numbers; ``select`` gives the number at a place.

    The ``low`` bits of each number are packed; its high part h at place i sets bit h + i of ``high``, whose ones are counted by word."""

    def __init__(self, numbers: np.ndarray):
        self.n = n = len(numbers)
        self.bits = max(0, (int(numbers[-1]) // n).bit_length() - 1) if n else 0
        high = np.zeros(-(-((int(numbers[-1]) >> self.bits) + n) // 64) * 64 if n else 0, np.uint8)
        high[(numbers >> self.bits) + np.arange(n)] = 1
        self.high = np.packbits(high, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        low = (numbers[:, None] >> np.arange(self.bits)) & 1
        self.low = np.packbits(low.astype(np.uint8), bitorder="little")

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.high[word : word + 1].view(np.uint8), bitorder="little"))
        high = 64 * word + int(ones[i - self.before[word]]) - i
        at = i * self.bits
        own = np.unpackbits(self.low[at // 8 : -(-(at + self.bits) // 8)], bitorder="little")[at % 8 : at % 8 + self.bits]
        return (high << self.bits) + int(own @ (1 << np.arange(self.bits)))

    def __len__(self) -> int:
        return self.n


def _seed(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def infill(text: str, ends: EliasFano, doc_id: int | None) -> tuple[str, int | None, int | None, str]:
    """The form, the prefix's and the middle's code points, and the output of one document."""
    h1, h2, h3, h4 = _seed(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= _PLAIN_FROM:
        return "plain", None, None, text
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < _SPM_BELOW:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct texts with the ids that have them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(1).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(which, minlength=len(coded.dictionary))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), batch.column(0).take(pa.array(np.argsort(which, kind="stable"))))
        # The ids of a full group tell batches apart.
        spread = [zlib.crc32(repr(own.values[:_HOT].to_pylist()).encode()) if n >= _HOT else 0 for own, n in zip(ids, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([coded.dictionary, ids, pa.array(spread, pa.int64())], ["text", "ids", "spread"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each text; rows come sorted by the texts' hash."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows, size = [], 0
    now, index = None, {}
    for batch in batches:
        for key, text, ids in zip(*batch.columns, strict=True):
            if key.as_py() != now:
                now, index = key.as_py(), {}
            text = text.as_py()
            ends = index.get(text)
            if ends is None:
                ends = index[text] = EliasFano(boundaries(text))
            for doc_id in ids.values:
                rows.append((doc_id.as_py(), len(ends), *infill(text, ends, doc_id.as_py())))
                size += len(text) + 64
                if size > _CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fill_in_middle(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.mapInArrow(_together, "text string, ids array<long>, spread long").withColumn("key", F.xxhash64("text"))
    dealt = grouped.repartition("key", "spread").sortWithinPartitions("key").select("key", "text", "ids")
    return dealt.mapInArrow(_cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; no mark occurs in a text that isn't plain."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, second), F.instr(output, MIDDLE)
        start = len(first) + 1
        return F.substring(output, start, a - start), F.substring(output, a + len(second), b - a - len(second)), F.substring(output, b + len(MIDDLE), F.char_length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op13_distinct_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|(?s:[^A-Za-z])') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || s[i:i + 7] AS BIGINT)) AS h FROM t
), c AS (
  SELECT *, len(u) AS n, h[1] % (len(u) + 1) AS x, h[2] % (len(u) + 1) AS y, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
    THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:n], '') AS c FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
