"""WARC archives of captures, and the external merge of their indexes.

Writing. Every row becomes one WARC/1.1 record in a gzip member of its own, so that any record can be read alone by its offset and
length. The members are written through Spark's text sink as bytes; the sink's line separator is an empty gzip member, which unpacks to
nothing, so the files are plain ``.warc.gz`` files, committed like any Spark output and in any store Spark can write. Of captures with
equal payloads of ``REVISIT_BYTES`` or more, the one with the largest ``page_id`` is the response and the others revisit it: their
records have the HTTP headers and no payload. An archive holds as many records as keep it under ``ARCHIVE_BYTES`` by its longest page;
long pages (over ``LONG_BYTES``) have archives of their own.

Reading. Each archive is parsed member by member, payloads are hashed and held against their headers, and its index lines are sorted by
(URL key, timestamp, page_id): one run an archive, written in blocks of at most ``BLOCK_LINES`` lines with their first key.

Merging. The range of the whole key is cut at keys of a regular sample of the runs, of ``SAMPLED`` keys a range, so a URL with any
number of captures spreads over ranges; the number of ranges follows the number of lines. Runs are cut at the bounds. Each range reads
its blocks in the order of their first keys, which Spark sorts with spilling, and merges them with a loser tree: a block is opened
when the merge reaches its first key and closed at its last, so blocks that overlap are in memory and no others. Ranges are in order
and so are the rows within, which makes the output the globally ordered capture history.

The tables have no capture time; the date of a record is derived from its ``page_id``.

Defined cases: null html is empty, null url is an empty URI; rows that repeat the largest ``page_id`` of a group are all
responses; a null ``page_id`` is kept, and is the response only if its group has no other; lines of one whole key follow each other in
any order; an empty table gives no rows; one record, not one archive, must fit in a worker's memory unpacked, whatever the texts'
length; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, partitions, table, written

REVISIT_BYTES = 1000
LONG_BYTES, ARCHIVE_BYTES = 1 << 17, 1 << 28
BLOCK_LINES, RANGE_LINES, SAMPLED = 256, 500_000, 50
_END = "\r\n\r\n"
#: A gzip member without content, as RFC 1952 has it.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_KEY = ("urlkey", "timestamp", "page_id")


def url_key(url: str) -> str:
    """The URL with its host's labels reversed and without scheme, "www.", port and fragment, in lower case."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].split(":", 1)[0])
    return ",".join(reversed(host.split("."))) + ")" + (slash + path or "/")


class LoserTree:
    """A k-way merge of sorted runs: each inner node holds the loser of its match, the overall winner is at the root.

    Runs may be added while the merge is on, if they begin no earlier than what was taken last. A leaf without a run loses to all. A new
    run takes such a leaf, and only the matches on its way up are played anew, for which each node's winner is kept beside its loser;
    where no leaf is free, the tree doubles. So both a new run and a taken line cost the logarithm of the runs that are open."""

    def __init__(self, runs: Iterable[Iterator[tuple]] = ()):
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple | None] = []
        self.free: list[int] = []
        self.lost: list[int] = []
        self.won: list[int] = []
        self._double()
        for run in runs:
            self.add(run)

    def _double(self) -> None:
        k, more = 2 * len(self.runs) or 1, len(self.runs) or 1
        self.free += range(k - 1, k - more - 1, -1)
        self.runs += [iter(())] * more
        self.heads += [None] * more
        self.lost, self.won = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            self._match(node)

    def _match(self, node: int) -> None:
        a, b = self.won[2 * node], self.won[2 * node + 1]
        self.won[node], self.lost[node] = (a, b) if self._beats(a, b) else (b, a)

    def add(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is None:
            return
        if not self.free:
            self._double()
        leaf = self.free.pop()
        self.runs[leaf], self.heads[leaf] = run, head
        node = (leaf + len(self.runs)) // 2
        while node > 0:
            self._match(node)
            node //= 2

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def head(self) -> tuple | None:
        return self.heads[self.won[1]]

    def pop(self) -> tuple:
        """The least head; its run's next one plays against the losers on its way up."""
        leaf = self.won[1]
        taken = self.heads[leaf]
        self.heads[leaf] = next(self.runs[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node > 0:
            if not self._beats(winner, self.lost[node]):
                self.lost[node], winner = winner, self.lost[node]
            self.won[node] = winner
            node //= 2
        return taken

    def __iter__(self) -> Iterator[tuple]:
        while self.head() is not None:
            yield self.pop()


def write_archives(df: DataFrame, path: str) -> None:
    """WARC files of ``df`` (page_id, url, html) in the folder ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = df.select(F.col("page_id").cast("long"), uri.alias("uri"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    # One row a digest, counted before the shuffle; only digests that occur more than once are joined back.
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter((F.col("n") > 1) | (F.col("bytes") > LONG_BYTES)), "digests")
    longest = groups.agg(F.max("bytes")).first()[0] or 0
    keepers = groups.filter((F.col("n") > 1) & (F.col("bytes") >= REVISIT_BYTES)).select("digest", "keeper")
    rows = rows.join(keepers, "digest", "left").withColumn("revisit", F.expr("keeper is not null and not keeper <=> page_id"))

    def urn(c: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    date = F.date_format(F.timestamp_seconds(1_700_000_000 + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("revisit"), F.concat(F.lit(f"revisit{line}WARC-Profile: {_PROFILE}{line}WARC-Refers-To: "), urn("keeper"))).otherwise(F.lit("response"))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), urn("page_id")), F.concat(F.lit("WARC-Date: "), date)]
    head += [F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))]
    head += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    records = rows.select((F.col("bytes") > LONG_BYTES).alias("long"), F.concat(F.concat_ws(line, *head), F.lit(_END), block, F.lit(_END)).alias("value"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                machine = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = machine.compress(value.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([packed + machine.flush()], pa.binary())], ["value"])

    # The text sink writes a string's bytes as they are; its separator is given in Latin-1, byte for byte.
    plain = {"lineSep": _EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "compression": "none"}
    for long, bytes_each in ((False, LONG_BYTES), (True, longest)):
        if long and longest <= LONG_BYTES:
            continue
        packed = records.filter("long" if long else "not long").select(F.col("value").cast("binary")).mapInArrow(members, "value binary").select(F.col("value").cast("string"))
        packed.write.mode("append").options(**plain).option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (bytes_each + 4096))).text(path)


def read_record(packed: bytes | memoryview, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers in lower case, block, and packed length of the record whose gzip member begins at ``offset``."""
    machine = zlib.decompressobj(31)
    raw = machine.decompress(memoryview(packed)[offset:])
    head, _, rest = raw.partition(_END.encode())
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {offset}")
    headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + len(_END):
        raise ValueError(f"the record at byte {offset} isn't as long as it says")
    return headers, rest[:size], len(packed) - offset - len(machine.unused_data)


def read_records(packed: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, packed length, headers, block) of each record of an archive; one is unpacked at a time."""
    at = 0
    while at < len(packed):
        if bytes(packed[at : at + len(_EMPTY_MEMBER)]) == _EMPTY_MEMBER:
            at += len(_EMPTY_MEMBER)
            continue
        headers, block, length = read_record(packed, at)
        yield at, length, headers, block
        at += length


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits else None


def index_line(offset: int, length: int, headers: dict[str, str], block: bytes, archive: str) -> tuple:
    http, _, payload = block.partition(_END.encode())
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{archive}, byte {offset}: the payload isn't the one that was written")
    url = headers["warc-target-uri"]
    stamp = re.sub(r"\D", "", headers["warc-date"])
    return url_key(url), stamp, _page(headers["warc-record-id"]), url, size, digest, kind, _page(headers.get("warc-refers-to")), archive, offset, length


def _order(line: tuple) -> tuple:
    return line[0], line[1], line[2] is not None, line[2] or 0  # nulls first, as Spark sorts


def _batch(lines: list[tuple], **more: list) -> pa.RecordBatch:
    """A batch of index lines; ``more``: columns of integers behind them."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in _INDEX.split(", ")]
    columns = [pa.array(c, t) for c, t in zip(list(zip(*lines, strict=True)) or [()] * len(names), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in more.values())], [*names, *more])


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index lines of the archives in ``path``, with ``place``, the line's place in its run: the archive's lines, sorted."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rpartition("/")[2]
                lines = sorted((index_line(*r, archive) for r in read_records(memoryview(content.as_buffer()))), key=_order)
                if lines:
                    yield _batch(lines, place=list(range(len(lines))))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(runs, _INDEX + ", place long")


def _bounds(runs: DataFrame, ranges: int, lines: int) -> list[tuple]:
    """Keys that cut all lines into ``ranges`` of about one size, from a regular sample of each run."""
    stride = max(1, lines // (ranges * SAMPLED))
    # The phase differs by run, so short runs are sampled in proportion. About ranges * SAMPLED keys.
    sample = runs.filter(F.pmod(F.col("place") + F.pmod(F.xxhash64("archive"), F.lit(stride)), F.lit(stride)) == 0).select(*_KEY).collect()
    keys = sorted(_order(tuple(r)) for r in sample)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def merge_runs(runs: DataFrame) -> DataFrame:
    """All index lines in global order, with ``sequence`` ascending along it. ``runs``: index lines with ``place``, as of ``index_runs``."""
    spark = runs.sparkSession
    lines = runs.count()
    ranges = partitions(spark, lines, RANGE_LINES)
    bounds = _bounds(runs, ranges, lines)
    n_columns = len(_INDEX.split(", "))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of runs: lines of one range in their order, BLOCK_LINES at most, as an Arrow stream; and their first key."""
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:n_columns]), strict=True))
            begin, out = 0, []
            cuts = [bisect_right(bounds, _order(r)) for r in rows]
            for end in range(1, len(rows) + 1):
                whole = end == len(rows) or end - begin == BLOCK_LINES or cuts[end] != cuts[begin] or rows[end][8] != rows[begin][8]
                if whole:
                    part = _batch(rows[begin:end])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as stream:
                        stream.write_batch(part)
                    out.append((cuts[begin], *rows[begin][:3], sink.getvalue().to_pybytes()))
                    begin = end
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", *_KEY, "body"])

    def opened(body: pa.Scalar) -> Iterator[tuple]:
        (part,) = pa.ipc.open_stream(body.as_buffer())
        lines = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
        return iter([(_order(x), x[8:10], x) for x in lines])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part, n, out = LoserTree(), None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, n
            batch = _batch(out, sequence=[(part << 40) + n + i for i in range(len(out))])
            n, out = n + len(out), []
            return batch

        for batch in batches:
            for own, urlkey, stamp, page, body in zip(*batch.columns, strict=True):
                own, first = own.as_py(), _order((urlkey.as_py(), stamp.as_py(), page.as_py()))
                # Everything below the next block's first key is final; a new range ends the one before.
                while (head := tree.head()) is not None and (own != part or head[0] < first):
                    out.append(tree.pop()[2])
                    if len(out) == 10_000:
                        yield flush()
                if own != part:
                    if out:
                        yield flush()
                    tree, part, n = LoserTree(), own, 0
                tree.add(opened(body))
        for _, _, line in tree:
            out.append(line)
            if len(out) == 10_000:
                yield flush()
        if out:
            yield flush()

    # Within a run the lines of a range are in order, and so are the first keys of its blocks; nulls come first, as in _order.
    ordered = runs.drop("place").mapInArrow(blocks, "part int, urlkey string, timestamp string, page_id long, body binary")
    return ordered.repartition(ranges, "part").sortWithinPartitions("part", *_KEY).mapInArrow(merged, _INDEX + ", sequence long")


def capture_history(df: DataFrame) -> DataFrame:
    """Write ``df`` (page_id, url, html) as archives, read them back, and merge their indexes into the capture history."""
    spark = df.sparkSession
    path = new_path(spark, "warc")
    write_archives(df, path)
    runs = written(index_runs(spark, path), "index-runs")
    return merge_runs(runs)


def op5_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, in the order of the capture history: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return capture_history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
