"""Harmonic packing of token streams into sequences of a fixed capacity C.

A piece of length n is in class k = C // n, the reciprocal-capacity class (C/(k+1), C/k]; a bin of class k takes exactly k
pieces of that class and is closed. Every worker fills its own bins and no rows move between workers. A document may be cut, so
its pieces are chosen to fit their class well: whole sequences first; then the rest stays whole if k such pieces leave at most
``slack`` of a bin unused, else a piece of C // (k+1), the top of the next class, is cut off and the remaining ids are treated
likewise. The bins a worker hasn't filled at its end are joined into one stream, cut at C, and the stream's last part into powers
of two, which need no padding.

Defined cases: a null or empty text is one piece, the end id; repeated rows are packed each; null doc_id stays null; a very long text is
encoded whole and cut into sequences; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import BYTE_MODEL, END_ID, encoder

CAPACITY = 2048
SLACK = 1 / 64
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        piece = rest if capacity - k * rest <= slack * capacity else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


class HarmonicBins:
    """One worker's bins. A piece is (doc_id, start, length, doc_tokens, ids); ``add`` and ``close`` return finished sequences."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open = capacity, {}

    def add(self, piece: tuple) -> list[tuple] | None:
        """The bin that this piece fills, if it does."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else None

    def close(self) -> Iterator[list[tuple]]:
        """What is left, without padding: sequences of the capacity, then of falling powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[2] for p in left)
        rest = total % self.capacity
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            made = []
            while size:
                doc_id, start, length, tokens, ids = left.pop()
                if length > size:
                    left.append((doc_id, start + size, length - size, tokens, ids[4 * size :]))
                    length, ids = size, ids[: 4 * size]
                made.append((doc_id, start, length, tokens, ids))
                size -= length
            yield made


def pack(df: DataFrame, tokenizer: str = BYTE_MODEL, end_id: int = END_ID, capacity: int = CAPACITY, slack: float = SLACK, special_text: bool = True) -> DataFrame:
    """Pieces of ``df`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, ways = encoder(tokenizer, special_text), HarmonicBins(capacity), {}
        sequence, rows, size = TaskContext.get().partitionId() << 40, [], 0

        def emit(made: list[tuple]) -> None:
            nonlocal sequence, size
            offset = 0
            for doc_id, start, length, tokens, ids in made:
                rows.append((doc_id, start, length, tokens, sequence, offset, ids))
                offset += length
            size += offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            kinds = (*[pa.int64()] * 6, pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows, size = [], 0
            return out

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, ids = d.as_py(), encode(t.as_py()) + end
                n, start = len(ids) // 4, 0
                whole, rest = divmod(n, capacity)
                if rest not in ways:
                    ways[rest] = cuts(rest, capacity, slack)
                for length in [capacity] * whole + ways[rest]:
                    if made := bins.add((doc_id, start, length, n, ids[4 * start : 4 * (start + length)])):
                        emit(made)
                    start += length
                if size >= 1 << 20:
                    yield flush()
        for made in bins.close():
            emit(made)
        if rows:
            yield flush()

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, _SCHEMA)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
