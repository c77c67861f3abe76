"""SimHash fingerprints and their exact linking within a Hamming radius.

Fingerprints. A text's words, lower-cased in A-Z and cut at ASCII white space, give shingles of ``shingle`` words, repeats
included, for near copies without them (a shorter text: all its words as one). A bit is set if it is set in over half of the shingles' XXH64 values. A longer
fingerprint has several lanes of 64 bits, the later ones of mixed hashes.

Linking. Equal fingerprints are one class (for near copies: equal sets of shingles). The distinct ones are dealt into tiles by their population counts, taken over equal
blocks of the first lane: two fingerprints within the radius differ by at most the radius in the sum of their blocks' counts, so
tile pairs beyond it are skipped and no link is lost. More blocks make more and smaller tiles; their number follows the number
of fingerprints and changes no result. For a wide radius, where bit counts skip nothing, the population that counts is that of a
text's distinct shingles: texts whose numbers of them are in a ratio under ``ratio`` have a lower Jaccard similarity than that, so
numbers are cut into bands of this ratio and only equal and neighbouring bands are compared. A tile that holds more than ``tile``
is split by a hash. Every remaining pair of tiles is compared in full with numpy's exclusive-or and bit counts, and gives a
spanning forest of its links, of the fewest differing bits, not all pairs. Connected components of these edges are the groups.

Near copies (with ``ratio``). The radius is only where the first candidates lie: an edge counts if the two texts' sets of shingles
have a Jaccard similarity of ``ratio`` or more. A failing edge may hide another that holds; more ``forests``, each of what the ones before
leave, try more of the nearest pairs first. Edges grow with the number of fingerprints, not with the pairs in a group.

Then all links that are left are found exactly, by a prefix filter: with all shingles in one order, two sets of this similarity share
``k`` of their first shingles, of which a set of ``n`` has ``n - ceil(ratio * n) + k``, for any ``k``; here it is ``1 + n // 25``. Pairs
that share as many, that the links so far don't connect, and that can still reach the similarity behind their first common shingle are
held against the texts: first only pairs with hubs, of each group that has a shingle the node of most links, since the copies of one
text are often near to it and not to each other; then, of what is still apart, all. The order is by hash with common shingles last, as a
sample tells them; it decides what this costs, not what it finds.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; null ``doc_id`` is kept, and named only
where a group has no other; repeated rows stay, and go from ``drop_near_copies``, as does all but one row of rows that tie; an empty table
gives no rows; a very long text is hashed whole, by parts; other columns, whatever their names, are kept by ``drop_near_copies`` and
ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import discard, fresh, table, written

SHINGLE, RADIUS, SEED, TILE = 3, 3, 42, 1024
SHARED_EACH = 25
#: For near copies: five words and a similarity of 0.8. At that Jaccard similarity the cosine is 0.89 and about 39 of 256 bits
#: differ; the nearest pairs within 56 connect most of a group, and the prefix filter finds every link that they leave.
COPIES = {"shingle": 5, "lanes": 4, "radius": 56, "tile": 16384, "ratio": 0.8, "forests": 1}


def shingle_parts(text: str | None, size: int, part: int = 1 << 14) -> Iterator[list[bytes]]:
    """A text's shingles, space-joined, repeats included, at most ``part`` at a time; fewer words: all of them; none: no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space
    joined = b" ".join(words)
    if len(words) <= size:
        if words:
            yield [joined]
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate([[0], ends[:-size]]), ends[size - 1 :] - 1
    del words
    for at in range(0, len(ends), part):
        yield [joined[a:b] for a, b in zip(starts[at : at + part].tolist(), ends[at : at + part].tolist(), strict=True)]


def _hashed(part: list[bytes], seed: int) -> np.ndarray:
    """The XXH64 values of shingles, as rows of eight bytes."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, seed) for s in part]), np.uint8).reshape(-1, 8)


def distinct_shingles(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """The sorted XXH64 values of a text's distinct shingles."""
    parts = [np.unique(_hashed(p, seed).reshape(-1).view(np.uint64)) for p in shingle_parts(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits for each hash, by SplitMix64, whose constants are fixed."""
    z = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def set_digest(shingles: np.ndarray) -> int:
    """64 signed bits that name a text's set of distinct shingles, sorted."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED, lanes: int = 1, ratio: float = 0.0) -> tuple[list[int], int, np.ndarray]:
    """The lanes of a text's fingerprint, unsigned, the band of its number of distinct shingles (0 without shingles), and these, sorted;
    band 0 and none for all texts without a ``ratio``. With one, each distinct shingle counts once."""
    counts, n = np.zeros((lanes, 64), np.int64), 0
    if ratio:
        own = distinct_shingles(text, size, seed)
        parts = (own[at : at + (1 << 14)] for at in range(0, len(own), 1 << 14))
    else:
        own = np.empty(0, np.uint64)
        parts = (_hashed(p, seed).reshape(-1).view(np.uint64) for p in shingle_parts(text, size))
    for hashes in parts:
        n += len(hashes)
        for k in range(lanes):
            bits = (_mixed(hashes, k) if k else hashes).view(np.uint8).reshape(-1, 8)
            counts[k] += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    band = 1 + math.floor(math.log(len(own)) / -math.log(ratio)) if len(own) else 0
    return [int.from_bytes(np.packbits(2 * c > n).tobytes(), "big") for c in counts], band, own


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(df: DataFrame, shingle: int = SHINGLE, seed: int = SEED, lanes: int = 1, ratio: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``fp`` (its lanes as longs), ``band``, ``digest`` and the string columns ``keep`` of each row of ``df`` (doc_id, text);
    with a ``ratio``, also the number ``n`` of distinct shingles and the first of them, ``prefix``."""
    common = common_shingles(df, shingle, seed) if ratio else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, digests, sizes, firsts = [], [], [], [], []
            for t in batch.column(1):
                fp, band, own = fingerprint(t.as_py(), shingle, seed, lanes, ratio)
                fps.append(np.array(fp, np.uint64).view(np.int64))
                bands.append(band)
                digests.append(set_digest(own) if ratio else 0)
                sizes.append(len(own))
                firsts.append(prefix(own, ratio, common).view(np.int64) if ratio else own.view(np.int64))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *x]))) for x in (fps, firsts)]
            columns = [batch.column(0), lists[0], pa.array(bands, pa.int32()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), lists[1], *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "band", "digest", "n", "prefix", *keep])

    made = df.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(of, "doc_id long, fp array<bigint>, band int, digest long, n int, prefix array<bigint>" + "".join(f", {k} string" for k in keep))
    return made if ratio else made.drop("n", "prefix")


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row and column numbers of all pairs of fingerprints (n, lanes) that differ in at most ``radius`` bits, and those bits; by blocks
    of rows."""
    lanes = a.shape[1]
    first = max(1, min(3, lanes - 1))
    step = max(1, (1 << 20) // max(len(b), 1))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        bits = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        for k in range(1, first):
            bits += np.bitwise_count(part[:, None, k] ^ b[None, :, k])
        r, c = np.nonzero(bits <= radius)
        bits = bits[r, c].astype(np.int32)
        if first < lanes and len(r):  # the other lanes only of pairs that the first ones leave
            bits += np.bitwise_count(part[r, first:] ^ b[c, first:]).sum(axis=1, dtype=np.int32)
            near = bits <= radius
            r, c, bits = r[near], c[near], bits[near]
        yield r + at, c, bits


def _least_forest(n: int, r: np.ndarray, c: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which edges between ``n`` nodes are in a spanning forest of least ``bits``; edges come sorted by them."""
    label, taken = np.arange(n), np.zeros(len(r), bool)
    bounds = np.concatenate([[0], np.nonzero(np.diff(bits))[0] + 1, [len(bits)]])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at = np.arange(lo, hi)
        while True:
            x, y = label[r[at]], label[c[at]]
            apart = x != y
            if not apart.any():
                break
            at, x, y = at[apart], x[apart], y[apart]
            # Each label is hung on a lesser one by one edge, so no circle arises.
            moved, first = np.unique(np.maximum(x, y), return_index=True)
            taken[at[first]] = True
            to = np.arange(n)
            to[moved] = np.minimum(x, y)[first]
            while not (to[to] == to).all():
                to = to[to]
            label = to[label]
    return taken


def _forests(names: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, radius: int, forests: int) -> np.ndarray:
    """Edges (n, 2) between the nodes of two tiles (or of one tile with itself): ``forests`` spanning forests of all pairs within
    ``radius``, of least bits, each of what the ones before leave. Pairs are thinned out as they are found, never all held."""
    held = [np.empty((3, 0), np.int32)]

    def thin(last: bool) -> None:
        if not last and sum(x.shape[1] for x in held) < 1 << 21:
            return
        left = np.concatenate(held, axis=1)
        left = left[:, np.argsort(left[2], kind="stable")]
        held.clear()
        for _ in range(forests):
            taken = _least_forest(len(names), *left)
            held.append(left[:, taken])
            left = left[:, ~taken]

    for r, c, bits in _within(a, b, radius):
        if same:
            up = r < c
            r, c, bits = r[up], c[up], bits[up]
        if len(r):
            held.append(np.stack([r, c if same else c + len(a), bits]).astype(np.int32))
            thin(False)
    if len(held) > 1:
        thin(True)
    return names[np.concatenate(held, axis=1)[:2].T]


def _blocks(n: int, radius: int) -> int:
    """Blocks whose population counts tile ``n`` fingerprints; a wide radius leaves them nothing to skip."""
    return 0 if radius > 8 else 2 if n <= 1 << 21 else 4 if n <= 1 << 30 else 8


def hamming_links(fps: DataFrame, radius: int = RADIUS, lanes: int = 1, tile: int = TILE, forests: int = 1) -> DataFrame:
    """Edges (a, b) between the nodes of ``fps`` (node, fp: ``lanes`` longs, band) that connect all that lie within ``radius`` bits, in
    equal or neighbouring bands; with more ``forests``, that many ways where there are as many."""
    blocks = _blocks(fps.count(), radius)
    width = 64 // max(blocks, 1)
    base = width + 1
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    counts = [F.bit_count(F.shiftrightunsigned(F.get("fp", F.lit(0)), i * width).bitwiseAND(mask)) for i in range(blocks)]
    sign = sum((c * F.lit(base**i) for i, c in enumerate(counts)), F.col("band") * F.lit(base**blocks)).cast("long")
    fps = fps.select("node", "fp", sign.alias("sign"))
    # At most base ** blocks rows a band: 1,089 signatures with two blocks, 83,521 with four.
    sizes = fps.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).select("sign", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    sizes = written(sizes, "tile-sizes")
    tiles = written(
        fps.join(sizes, "sign")
        .withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .groupBy("sign", "part")
        .agg(F.collect_list(F.struct("node", "fp")).alias("t"))
        .select("sign", "part", F.struct(F.col("t.node").alias("node"), F.flatten("t.fp").alias("fp")).alias("tile")),
        "tiles",
    )
    # Signatures within the radius of each other, by equal keys: shift the counts by every difference of that size.
    digit = lambda i: F.floor(F.col("sign") / base**i) % base
    shifts = [d for d in product(range(-min(radius, width), min(radius, width) + 1), repeat=blocks) if sum(map(abs, d)) <= radius]
    steps = [(k * base**blocks + sum(x * base**i for i, x in enumerate(d)), d) for k in (-1, 0, 1) for d in shifts]
    shift = F.explode(F.array(*[F.struct(F.lit(by).cast("long").alias("by"), *[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for by, d in steps]))
    inside = [(digit(i) + F.col(f"s.d{i}")).between(0, width) for i in range(blocks)]
    near = sizes.select("sign", shift.alias("s"))
    for x in inside:
        near = near.filter(x)
    near = near.select(F.col("sign").alias("other"), (F.col("sign") + F.col("s.by")).alias("sign")).filter("sign <= other").join(sizes, "sign")
    pairs = (
        tiles.select(F.col("sign").alias("other"), F.col("part").alias("other_part"), F.col("tile").alias("others"))
        .join(near, "other")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter("sign < other or part <= other_part")
        .join(tiles, ["sign", "part"])
        .select("tile", "others", F.expr("sign = other and part = other_part").alias("same"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            node, fp = ([c.field(k) for c in batch.columns[:2]] for k in (0, 1))
            for i, same in enumerate(batch.column(2).to_pylist()):
                names = [np.asarray(c[i].values) for c in node]
                a, b = (np.asarray(c[i].values).view(np.uint64).reshape(-1, lanes) for c in fp)
                found.append(_forests(names[0] if same else np.concatenate(names), a, b, same, radius, forests))
            edges = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def similar_edges(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``edges`` (a, b) whose ``texts`` (node, text) have a Jaccard similarity of at least ``least``, by all their shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(maxsize=16)(lambda text: distinct_shingles(text, shingle))
        for batch in batches:
            alike = [similarity(own(x.as_py()), own(y.as_py())) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    # Texts are never broadcast; a node of many edges is split by Spark's skew join.
    texts = texts.hint("merge")
    sides = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def common_shingles(df: DataFrame, shingle: int, seed: int = SEED, most: int = 1 << 16) -> np.ndarray:
    """Hashes of the commonest shingles in a sample of the texts of ``df``, the commonest last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(t.as_py(), shingle, seed).view(np.int64))], ["h"])

    sample = df.filter(F.pmod(F.xxhash64("text"), F.lit(32)) == 0).select("text").mapInArrow(of, "h long")
    found = sample.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(most).collect()
    return np.array([r.h for r in reversed(found)], np.int64).view(np.uint64)


def least_shared(n: int) -> int:
    """How many of their first shingles two similar sets of ``n`` or more must share."""
    return 1 + n // SHARED_EACH


def prefix(own: np.ndarray, ratio: float, common: np.ndarray) -> np.ndarray:
    """The first of the distinct shingles ``own``: any set with a similarity of ``ratio`` to them shares ``least_shared`` of the smaller
    set's size of its own first ones."""
    rank = np.zeros(len(own), np.int64)
    if len(common):
        by_hash = np.argsort(common)
        at = by_hash[np.minimum(np.searchsorted(common, own, sorter=by_hash), len(common) - 1)]
        rank = np.where(common[at] == own, at + 1, 0)
    return own[np.lexsort((own, rank))][: len(own) - math.ceil(ratio * len(own) - 1e-9) + least_shared(len(own))] if len(own) else own


def shared_prefixes(prints: DataFrame) -> DataFrame:
    """(h, node, n, at) of ``prints`` (as of ``fingerprints`` with a ratio): those first shingles that two or more sets have."""
    posted = prints.select(F.col("digest").alias("node"), "n", F.posexplode("prefix").alias("at", "h"))
    shared = posted.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("h")
    return written(posted.join(shared.hint("merge"), "h").distinct(), "shared-prefixes")


def prefix_pairs(posted: DataFrame, roots: DataFrame, ratio: float, degrees: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes with different ``roots`` (node, root; absent: the node itself), among them every such pair of sets with a
    similarity of ``ratio``. With ``degrees`` (node, links), of each group that has a shingle only the node of most links is paired."""
    posted = posted.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A shingle of one group only has nothing to add.
    mixed = posted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    if degrees is not None:
        posted = posted.join(degrees.hint("merge"), "node", "left")
        hub = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node", "n", "at"))
        posted = posted.join(mixed.hint("merge"), "h").groupBy("h", "root").agg(hub.alias("hub")).select("h", "root", "hub.node", "hub.n", "hub.at", "hub.links")
    else:
        posted = posted.join(mixed.hint("merge"), "h").select("h", "root", "node", "n", "at", F.lit(0).alias("links"))
    posted = written(posted, "open-prefixes")
    x, y = (posted.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "at", "root", "links")]) for k in "ab")
    # Behind their first common shingle no more can be common than the shorter rest, behind the k-th k - 1 less; the float's last digits
    # are left a margin.
    least = F.lit(1) if degrees is not None else 1 + F.floor(F.least("n_a", "n_b") / SHARED_EACH)
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    able = rest + least - 1 >= (F.col("n_a") + F.col("n_b")) * F.lit(ratio / (1 + ratio)) - 1e-6
    pairs = x.hint("merge").join(y, "h").filter((F.col("root_a") < F.col("root_b")) & able)
    if degrees is not None:  # a hub's other shingles may have other hubs, so what is shared isn't counted; two that have no links can wait
        return pairs.filter("links_a + links_b > 0").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    pairs = pairs.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("shared"), F.first(least).alias("least"))
    return pairs.filter("shared >= least").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def groups(
    df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, lanes: int = 1, tile: int = TILE, ratio: float = 0.0, forests: int = 1, keep: Sequence[str] = ()
) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, fp, the string columns ``keep``, and ``root``, equal for all that links connect.

    With a ``ratio``, links are held against the texts; the first of ``keep`` then tells texts apart."""
    prints = written(fingerprints(df, shingle, seed, lanes, ratio, keep), "fingerprints")
    node = F.col("digest") if ratio else F.get("fp", F.lit(0)) if lanes == 1 else F.xxhash64("fp", "band")
    distinct = written(prints.select("fp", "band", "digest").distinct().withColumn("node", node), "distinct-fingerprints")
    edges = hamming_links(distinct, radius, lanes, tile, forests)

    def held(edges: DataFrame) -> DataFrame:
        edges = written(edges.distinct(), "near-pairs")
        linked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = prints.groupBy(node.alias("node")).agg(F.min(keep[0]).alias(keep[0])).join(linked, "node")
        texts = df.select(keep[0], "text").join(one.hint("merge"), keep[0]).groupBy("node").agg(F.first("text").alias("text"))
        return similar_edges(edges, written(texts, "linked-texts"), shingle, ratio)

    if ratio:
        linked = written(held(edges), "near-links")
        roots, posted = components(linked), shared_prefixes(prints)
        for hubs in (True, False):
            degrees = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links")) if hubs else None
            more = written(held(prefix_pairs(posted, roots, ratio, degrees)), "exact-links")
            if not more.isEmpty():
                roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        discard(posted)
    else:
        roots = components(edges)
    grouped = distinct.join(roots.withColumnRenamed("node", "rooted"), F.col("node") == F.col("rooted"), "left").select("fp", "band", "digest", F.coalesce("root", "node").alias("root"))
    return prints.join(grouped, ["fp", "band", "digest"]).select("doc_id", "fp", *keep, "root")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, lanes: int = 1, tile: int = TILE) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, fp, and component_id, the smallest doc_id that it reaches by links."""
    found = written(groups(df, shingle, radius, seed, lanes, tile), "groups")
    # Written, so that the join behind it can be split where a group is large.
    least = written(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    return found.join(least, "root").select("doc_id", "fp", "component_id")


def drop_near_copies(df: DataFrame, **how: float) -> DataFrame:
    """``df`` with one row of each group of near copies (``COPIES``, or ``how``), with all columns: that with the smallest doc_id.

    Rows that share the smallest ``doc_id`` are told apart by text, and of repeated rows one stays; nulls come last."""
    (key,) = fresh(df, "row_key")
    told = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    keyed = df.withColumn(key, told)
    found = written(groups(keyed.select("doc_id", "text", F.col(key).alias("row_key")), **(COPIES | how), keep=["row_key"]), "groups")
    # One row of each group: the least, with nulls last. Each key that stays does so once.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    one = written(found.groupBy("root").agg(least.alias(key)).select(key), "stays")
    twice = written(found.groupBy(F.col("row_key").alias(key)).count().filter("count > 1").select(key).join(one.hint("merge"), key, "left_semi"), "repeated-rows")
    # These lists grow with the corpus, so they are never broadcast.
    rest = keyed.join(one.hint("merge"), key, "left_semi")
    names = [f"`{c}`" for c in df.columns]
    if twice.isEmpty():
        return rest.select(names)
    again = rest.join(twice.hint("merge"), key, "left_semi").dropDuplicates([key])
    return rest.join(twice.hint("merge"), key, "left_anti").select(names).unionByName(again.select(names))


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")
