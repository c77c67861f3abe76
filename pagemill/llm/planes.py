"""Token-ID files with shuffled planes.

A file set is a folder of Parquet files whose rows are *segments*. A segment holds whole documents in ascending ``doc_id``
order. Its ids are cut into blocks of a fixed size; each block's 32-bit ids are transposed into four byte planes or thirty-two
bit planes, and every plane is compressed with zstandard. The segment's header has the documents' ids and lengths and the chunk
index: offset and compressed size of every plane. The columns beside the segment (part, seg, part_start, n_ids, n_docs) index
the segments themselves and can be read without the bodies.

Defined cases: a null text has the end id only; null ``doc_id`` sorts first and comes back null; rows of one ``doc_id`` are ordered by
their texts' hashes, so any number of them is spread over tasks; repeated rows stay; a very long text makes a segment of its own size;
an empty table gives an empty file set; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, partitions, table
from .tokens import END_ID, WORD_MODEL, encoder

MAGIC = b"PLN1"
BLOCK = 1 << 16
SEGMENT_IDS = 1 << 20
#: Rows a task at most, on average.
ROWS_EACH = 1 << 15
_HEAD = struct.Struct("<4sBxxxIQQII")  # magic, planes, block, ids, documents, bytes of the document list, blocks
_SCHEMA = "part int, seg int, part_start long, n_ids long, n_docs long, body binary"


def split_planes(block: np.ndarray, planes: int) -> list[bytes]:
    """The planes of one block of ids: 4 byte planes or 32 bit planes, least significant first."""
    raw = block.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of ``split_planes``."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack_segment(doc_ids: list[int | None], ids: list[bytes], planes: int = 4, block: int = BLOCK, level: int = 3) -> bytes:
    """One segment's bytes. ``ids``: each document's ids as little-endian unsigned 32-bit integers."""
    put = zstandard.ZstdCompressor(level=level).compress
    stream = np.frombuffer(b"".join(ids), "<u4")
    listed = b"".join((
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(i) // 4 for i in ids], "<u8").tobytes(),
    ))
    listed = put(listed)
    chunks = [put(p) for at in range(0, len(stream), block) for p in split_planes(stream[at : at + block], planes)]
    index = np.zeros((len(chunks), 2), "<u8")
    index[:, 1] = [len(c) for c in chunks]
    index[1:, 0] = np.cumsum(index[:-1, 1])
    head = _HEAD.pack(MAGIC, planes, block, len(stream), len(doc_ids), len(listed), -(-len(stream) // block))
    return b"".join((head, listed, index.tobytes(), *chunks))


def unpack_segment(body: bytes) -> Iterator[tuple[int | None, bytes]]:
    """Each document's id and ids, in order; one block is open at a time."""
    magic, planes, block, n, n_docs, listed, n_blocks = _HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a segment of a plane file")
    get = zstandard.ZstdDecompressor().decompress
    raw = get(body[_HEAD.size : _HEAD.size + listed]) if n_docs else b""
    null, doc_ids, lengths = np.frombuffer(raw, np.uint8, n_docs), np.frombuffer(raw, "<i8", n_docs, n_docs), np.frombuffer(raw, "<u8", n_docs, 9 * n_docs)
    at = _HEAD.size + listed
    index = np.frombuffer(body, "<u8", 2 * n_blocks * planes, at).reshape(-1, planes, 2)
    at += index.nbytes
    held, begin, b = np.empty(0, "<u4"), 0, 0
    for is_null, doc_id, length in zip(null.tolist(), doc_ids.tolist(), lengths.tolist(), strict=True):
        parts, need = [], length
        while need:
            if begin == len(held):
                size = min(block, n - b * block)
                held, begin = join_planes([get(body[at + int(o) : at + int(o) + int(s)]) for o, s in index[b]], size), 0
                b += 1
            take = held[begin : begin + need]
            parts.append(take.tobytes())
            begin, need = begin + len(take), need - len(take)
        yield (None if is_null else doc_id), b"".join(parts)


def write_planes(df: DataFrame, path: str, tokenizer: str = WORD_MODEL, end_id: int = END_ID, planes: int = 4, block: int = BLOCK, special_text: bool = True) -> None:
    """Encode ``df`` (doc_id, text), append ``end_id`` to each document, and write a file set in ascending doc_id order."""
    spark = df.sparkSession
    end = struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, special_text), TaskContext.get().partitionId()
        seg = done = held = 0
        doc_ids, ids = [], []

        def flush() -> pa.RecordBatch:
            body = pack_segment(doc_ids, ids, planes, block)
            row = [[part], [seg], [done], [held], [len(doc_ids)], [body]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seg", "part_start", "n_ids", "n_docs", "body"])

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(d.as_py())
                ids.append(encode(t.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
                    seg, done, held = seg + 1, done + held, 0
                    doc_ids, ids = [], []
        if doc_ids:
            yield flush()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(partitions(spark, df.count(), ROWS_EACH), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(segments, _SCHEMA).write.option("compression", "none").parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers) from a file set."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    # One row for each partition that wrote, at most as many as the writer's shuffle had.
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, base = {}, 0
    for part, n in totals:
        bases[part], base = base, base + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, rows, size = bases[part] + start, [], 0
                for doc_id, ids in unpack_segment(body.as_py()):
                    rows.append((doc_id, at, len(ids) // 4, ids))
                    at, size = at + len(ids) // 4, size + len(ids)
                    if size >= 1 << 22:
                        yield rows_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield rows_batch(rows)

    def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return files.select("part", "part_start", "body").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the read-back file set: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "planes")
    write_planes(table(spark, sf_dir, "documents"), path)
    return read_planes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
