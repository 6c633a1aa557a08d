"""Sinks beyond Spark's own: one file for each row, put in place by renaming.

`write_files` writes rows (path, content) as files of their own below a folder. A task writes each file under a name
that starts with a dot and renames all of them when it has come to its end, so a reader sees whole files only and a
task that fails leaves none. A task's list of what it has put in place lies beside the files, not in the driver;
if the job is aborted, what its other tasks have put in place goes as well. At the end `_SUCCESS` says how many files there are.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, LISTS = "parley_files", "_lists"


@dataclass
class Written(WriterCommitMessage):
    """What a task says: where its list is and how many files it has."""

    listed: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def store(self) -> tuple[fs.FileSystem, str]:
        found, root = fs.FileSystem.from_uri(self.folder)
        return found, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self.store()
        attempt, done = uuid.uuid4().hex, []
        try:
            for row in iterator:
                name = posixpath.normpath(row.path)
                if name.startswith(("..", "/")) or name == ".":
                    raise ValueError(f"not a path below the folder: {row.path}")
                target = f"{root}/{name}"
                hidden = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{attempt}"
                store.create_dir(posixpath.dirname(target))
                with store.open_output_stream(hidden) as out:
                    out.write((row.content or "").encode())
                done.append((hidden, target))
            listed = f"{LISTS}/{attempt}"
            store.create_dir(f"{root}/{LISTS}")
            with store.open_output_stream(f"{root}/{listed}") as out:
                out.write(json.dumps([target[len(root) + 1 :] for _, target in done]).encode())
        except BaseException:
            for hidden, _ in done:
                store.delete_file(hidden)
            raise
        for hidden, target in done:
            store.move(hidden, target)
        return Written(listed, len(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.store()
        if any(messages):
            store.delete_dir(f"{root}/{LISTS}")
        store.create_dir(root)
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in messages if m)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self.store()
        for m in messages:
            if m:
                with store.open_input_stream(f"{root}/{m.listed}") as listed:
                    for name in json.loads(listed.read()):
                        store.delete_file(f"{root}/{name}")
                store.delete_file(f"{root}/{m.listed}")


class FilesSource(DataSource):
    """`df.write.format(FORMAT)`: columns path and content, option path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.names != ["path", "content"]:
            raise ValueError("the columns have to be path and content")
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row (path, content) as a file of its own below `folder`."""
    rows.sparkSession.dataSource.register(FilesSource)
    rows.select("path", "content").write.format(FORMAT).mode("append").option("path", folder).save()
