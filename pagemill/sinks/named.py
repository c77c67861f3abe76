"""A data source that writes files by name, all of a job or none.

``df.write.format("namedfiles").mode("append").option("staging", folder).save()`` takes rows (target, content). Tasks write into ``staging``, a
folder of the job's own; when all have succeeded, each file is moved to its name, and the folder goes. When a task fails for good, the
folder goes with all that any task left there, and no target has been touched. A task that runs twice writes under two names, of which
only the one that it reports counts. A driver that is lost while it moves files leaves the rest in ``staging``; the same job run again
writes all of them.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.parts import store_of

NAME = "namedfiles"
SCHEMA = "target string, content binary"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (staged path, target), both as the file system knows them."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options):
        if not (staging := options.get("staging")):
            raise ValueError("namedfiles needs a staging folder")
        self.staging = staging

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = store_of(self.staging)
        done = []
        for row in iterator:
            at = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(at) as out:
                out.write(bytes(row["content"]))
            done.append((at, store_of(row["target"])[1]))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = store_of(self.staging)
        files = [f for m in messages if m is not None for f in m.files]
        for folder in sorted({posixpath.dirname(target) for _, target in files}):
            store.create_dir(folder, recursive=True)
        for at, target in files:
            store.move(at, target)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, folder = store_of(self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        writer = NamedFilesWriter(self.options)
        store, folder = store_of(writer.staging)
        store.create_dir(folder, recursive=True)  # here and not in tasks, so that one that outlives an abort finds no folder
        return writer
