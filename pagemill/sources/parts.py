"""The parts of Word packages as rows: one row a part, read member by member.

``spark.read.format("wordparts").load(folder)`` lists the packages below a folder, deals them to tasks by bytes, and reads each archive
through its directory: a task holds one member at a time and never the package. Parts that aren't XML come without their content, unless
the option ``content`` is ``all``. A file that can't be read as an archive is one row with ``error`` and no part; damage inside an archive
is such a row behind the parts that were read.

Files are opened through Arrow's file systems (local, S3, GCS, HDFS and so on). For a store that only Spark's own readers open, read the packages
with ``binaryFile`` and hand them to ``parts_of``.

Options: ``pathGlob`` (``*.docx``), ``bytesPerTask`` (128 MB), ``content`` (``xml`` or ``all``).
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "wordparts"
SCHEMA = "path string, doc_id string, size long, part_name string, part_size long, sha256 string, content binary, error string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
_STEP = 1 << 20


def members(path: str, file: BinaryIO, size: int, everything: bool = False) -> Iterator[tuple]:
    """The rows of one package; of several members of one name the last counts."""
    whole = hashlib.sha256()
    while step := file.read(_STEP):
        whole.update(step)
    head = (path, whole.hexdigest(), size)
    try:
        with zipfile.ZipFile(file) as archive:
            for name, info in {i.filename: i for i in archive.infolist() if not i.is_dir()}.items():
                data = archive.read(info)
                kept = data if everything or name.endswith((".xml", ".rels")) else None
                yield (*head, name, len(data), hashlib.sha256(data).hexdigest(), kept, None)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError) as e:
        yield (*head, None, None, None, None, f"{type(e).__name__}: {e}")


def batched(rows: Iterator[tuple], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes of content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or b"") + 256
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def store_of(path: str):
    """The file system that a path names, and the path in it."""
    from pyarrow import fs

    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/]*))?(/.*)$", path, re.S)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), path if m is None else m[4]
    store, base = fs.FileSystem.from_uri(f"{m[1]}://{m[3]}/")
    return store, base.rstrip("/") + m[4]


@dataclass
class Files(InputPartition):
    """Paths of one task, with their sizes."""

    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class PartsReader(DataSourceReader):
    def __init__(self, options):
        if not (path := options.get("path")):
            raise ValueError("wordparts needs the path of a folder or of a package")
        self.path, self.glob = path, options.get("pathGlob", "*.docx")
        self.most, self.everything = int(options.get("bytesPerTask", 128 << 20)), options.get("content", "xml") == "all"

    def partitions(self) -> list[InputPartition]:
        """The packages below the path in the order of their names, as many a task as stay below its bytes."""
        from pyarrow import fs

        store, at = store_of(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name.lower(), self.glob.lower())]
        scheme = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", self.path)
        tasks: list[list[tuple[str, int]]] = [[]]
        for f in sorted(found, key=lambda f: f.path):
            if tasks[-1] and sum(s for _, s in tasks[-1]) + f.size > self.most:
                tasks.append([])
            tasks[-1].append(((scheme[0] if scheme else "file:") + f.path, f.size))
        return [Files(t) for t in tasks]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, size in partition.files:
                store, at = store_of(path)
                with store.open_input_file(at) as file:
                    yield from members(path, file, size, self.everything)

        yield from batched(rows())


class WordParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PartsReader(self.options)


def read_parts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The parts of all packages below ``path``."""
    spark.dataSource.register(WordParts)
    return spark.read.format(NAME).options(**options).load(path)


def parts_of(files: DataFrame) -> DataFrame:
    """The same rows from ``files`` (path, content) that a table already holds whole."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p.as_py(), c.as_buffer()) for b in batches for p, c in zip(b.column(0), b.column(1), strict=True))
        yield from batched(r for path, content in rows for r in members(path, io.BytesIO(content), content.size))

    return files.select("path", "content").mapInArrow(opened, SCHEMA)
