"""Product codes for vectors: k-means codebooks by filtered Lloyd rounds, and the codes of all vectors.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own. Rows are dealt into chunks of a
bounded size, and each chunk builds a kd-tree over each of its parts once: boxes, sums and counts of all nodes are kept with the rows
in a written table. A round takes the trees from the root down. In a node's box only entries can be nearest that no other entry beats
in the whole box; once one entry is left, the node's cached sum and count go to it and its rows are never looked at. Only leaves that
several entries share are compared row by row. Arithmetic is on integers throughout, so the chunks change no result.

What the driver holds is a codebook: entries times components, whatever the number of vectors.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped. A null id is kept and comes last in the
order of the first entries; of equal ids the smaller vector comes first; repeated rows are coded each. Fewer rows than entries give as
many entries as rows; an empty table gives no rows and no codebooks. Other columns, whatever their names, are ignored. Vectors of
different lengths, or of one that the number of parts doesn't divide, are an error. Components of any size are exact; an error that a
long can't hold is null.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_CELLS = 1 << 20  # of a chunk: rows times components
_LEAF = 32
_LONG = (1 << 63) - 1

Codebooks = list[np.ndarray]  # by part position: entries x components


def _exact(*arrays: np.ndarray) -> type:
    """The kind of integers in which squared distances between rows of ``arrays`` can't overflow."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    return np.int64 if (4 * most) ** 2 * max(a.shape[-1] for a in arrays) < 1 << 62 else object


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Each component x as floor(scale * x)."""
    low = np.floor(vectors * float(scale))
    if low.size and np.abs(low).max() >= 1 << 53:
        return np.array([[int(x) for x in row] for row in low], dtype=object)
    return low.astype(np.int64)


class Tree(NamedTuple):
    """A balanced kd-tree over the rows of a part: their order, the rows in it, and boxes and sums of each level's nodes."""

    order: np.ndarray
    rows: np.ndarray
    boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by level: low, high, sum


def _edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end in the order."""
    edges = np.array([0, n])
    for _ in range(level):
        halves = np.empty(2 * len(edges) - 1, np.int64)
        halves[::2], halves[1::2] = edges, (edges[:-1] + edges[1:]) // 2
        edges = halves
    return edges


def _levels(n: int) -> int:
    """Halvings until a leaf has ``_LEAF`` rows at most."""
    return max(0, -(-n // _LEAF) - 1).bit_length()


def build_tree(rows: np.ndarray) -> Tree:
    n = len(rows)
    order = np.arange(n)
    for level in range(_levels(n)):
        edges = _edges(n, level)
        own = rows[order]
        side = np.maximum.reduceat(own, edges[:-1]) - np.minimum.reduceat(own, edges[:-1])
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        # Each node's rows by the longest side of its box; the middle row begins the second half.
        order = order[np.lexsort((own[np.arange(n), side.argmax(axis=1)[node]], node))]
    own = rows[order]
    starts = [_edges(n, level)[:-1] for level in range(_levels(n) + 1)]
    return Tree(order, own, [(np.minimum.reduceat(own, s), np.maximum.reduceat(own, s), np.add.reduceat(own, s)) for s in starts])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _left(entries: np.ndarray, able: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries (nodes x entries) may still be nearest somewhere in the boxes, and the one nearest to each box's middle."""
    far = _squared(2 * entries[None], (low + high)[:, None])
    best = np.where(able, far, far.max() + 1).argmin(axis=1)
    other = entries[best][:, None]
    # The corner of the box that favours an entry most over the best one.
    corner = np.where(entries[None] > other, high[:, None], low[:, None])
    mine, its = _squared(entries[None], corner), _squared(other, corner)
    return able & ((mine < its) | ((mine == its) & (np.arange(len(entries)) <= best[:, None]))), best


def assign(tree: Tree, entries: np.ndarray, each_row: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """By entry: the sum and the number of its rows; with ``each_row`` also the entry of each row, in the rows' first order."""
    n, kind = len(tree.rows), _exact(tree.rows, entries)
    rows, entries = tree.rows.astype(kind), entries.astype(kind)
    sums, counts = np.zeros(entries.shape, object), np.zeros(len(entries), np.int64)
    found = np.zeros(n, np.int64) if each_row else None
    nodes, able = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    for level, (low, high, total) in enumerate(tree.boxes):
        edges = _edges(n, level)
        able, best = _left(entries, able, low[nodes].astype(kind), high[nodes].astype(kind))
        alone = able.sum(axis=1) == 1
        np.add.at(sums, best[alone], total[nodes[alone]].astype(object))
        np.add.at(counts, best[alone], edges[nodes[alone] + 1] - edges[nodes[alone]])
        if each_row:
            for node, entry in zip(nodes[alone], best[alone], strict=True):
                found[edges[node] : edges[node + 1]] = entry
        nodes, able = nodes[~alone], able[~alone]
        if not len(nodes) or level + 1 == len(tree.boxes):
            break
        nodes, able = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(able, 2, axis=0)
    if len(nodes):
        sizes = edges[nodes + 1] - edges[nodes]
        at = np.concatenate([np.arange(a, b) for a, b in zip(edges[nodes], edges[nodes + 1], strict=True)])
        far = _squared(rows[at][:, None], entries[None])
        own = np.where(np.repeat(able, sizes, axis=0), far, far.max() + 1).argmin(axis=1)
        np.add.at(sums, own, rows[at].astype(object))
        np.add.at(counts, own, 1)
        if each_row:
            found[at] = own
    if each_row:
        placed = np.empty(n, np.int64)
        placed[tree.order] = found
        found = placed
    return sums, counts, found


def _usable(df: DataFrame, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & fine)


def _trees(df: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """The chunks of ``df`` (id, label, v): ids, labels, trees (one tree a part position, pickled)."""

    def chunk(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        rows = whole(np.concatenate(vectors), scale)
        packed = pickle.dumps([build_tree(p) for p in np.split(rows, parts, axis=1)], protocol=5)
        columns = [pa.array([pa.concat_arrays(x).to_pylist()], pa.list_(pa.int64())) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([packed], pa.binary())], ["ids", "labels", "trees"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _CELLS // max(width, 1))
        ids, labels, vectors, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                lists = piece.column(2)
                if any(length != width for length in lists.value_lengths().to_pylist()):
                    raise ValueError(f"vectors have different lengths: the first has {width} components")
                if ids and n + piece.num_rows > most:
                    yield chunk(ids, labels, vectors)
                    ids, labels, vectors, n = [], [], [], 0
                ids.append(piece.column(0))
                labels.append(piece.column(1))
                vectors.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, width))
                n += piece.num_rows
        if n:
            yield chunk(ids, labels, vectors)

    return written(df.mapInArrow(chunks, "ids array<long>, labels array<long>, trees binary"), "trees")


def _next(trees: DataFrame, now: Codebooks) -> Codebooks:
    """The codebooks after a round: each entry is the mean of the parts nearest to it, rounded down; unused ones stay."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(c.shape, object) for c in now], [np.zeros(len(c), np.int64) for c in now]
        for batch in batches:
            for packed in batch.column(0):
                for p, tree in enumerate(pickle.loads(packed.as_py())):
                    s, c, _ = assign(tree, now[p], False)
                    sums[p] += s
                    counts[p] += c
        rows = [(p, e, j, Decimal(int(x)), int(counts[p][e])) for p, s in enumerate(sums) for e in range(len(s)) if counts[p][e] for j, x in enumerate(s[e])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "at", "total", "n"])

    by_task = trees.select("trees").mapInArrow(summed, "part int, entry int, at int, total decimal(38,0), n long")
    out = [c.astype(object) for c in now]
    # At most one row for each component of the codebooks.
    for part, entry, at, total, n in by_task.groupBy("part", "entry", "at").agg(F.sum("total"), F.sum("n")).collect():
        out[part][entry, at] = int(total) // n
    return [c.astype(_exact(c)) for c in out]


def _coded(trees: DataFrame, books: Codebooks) -> DataFrame:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, packed in zip(*batch.columns, strict=True):
                codes, errors = [], 0
                for tree, book in zip(pickle.loads(packed.as_py()), books, strict=True):
                    own = assign(tree, book, True)[2]
                    rows = np.empty_like(tree.rows)
                    rows[tree.order] = tree.rows
                    kind = _exact(rows, book)
                    codes.append(own.astype(np.uint8))
                    errors = errors + _squared(rows.astype(kind), book.astype(kind)[own]).astype(object)
                text = [row.tobytes().hex() for row in np.stack(codes, axis=1)]
                errors = pa.array([int(e) if e <= _LONG else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text, pa.string()), errors], ["id", "label", "code", "error"])

    return trees.mapInArrow(coded, "id long, label long, code string, error long")


def compress(
    df: DataFrame, vector: str, id_column: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """The rows (id, label, code, error) of ``df``'s usable vectors, and the codebooks. ``id_column`` and ``label`` are whole numbers.

    A code has two hex digits a part, so there can be 256 entries at most; ``error`` is the sum of the parts' squared distances."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = _usable(df.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")), "v")
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    if width % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {width} components")
    if len({len(r.v) for r in first}) > 1:
        raise ValueError("vectors have different lengths")
    books = np.split(whole(np.array([r.v for r in first], float).reshape(len(first), width), scale), parts, axis=1) if first else []
    trees = _trees(rows, width, parts, scale)
    for _ in range(rounds if first else 0):
        books = _next(trees, books)
    out = written(_coded(trees, books), "codes")
    discard(trees)
    return out, books


def listed(books: Codebooks) -> str:
    """All components, by part, entry and position."""
    return ",".join(str(int(x)) for book in books for x in book.ravel())


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")
    by_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"))
    by_label = by_label.select(F.col("label").alias("of"), F.expr("try_cast(e AS long)").alias("label_error"))
    digest = hashlib.sha256(listed(books).encode()).hexdigest()
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]), "left").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.v) AS v, min({{'far': {far}, 'entry': c.entry}}) AS m FROM p JOIN c{i} c USING (part) GROUP BY p.vec_id, p.part)")
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT part, m.entry AS entry, unnest(range(len(v))) AS j, unnest(v) AS x FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, entry))"""
            )
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {PARTS}) + 1:(part + 1) * (len(q) // {PARTS})] AS v FROM k, range({PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES}),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
d AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), d"""


OP11_SQL = _sql()
