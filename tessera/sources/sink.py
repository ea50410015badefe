"""A sink of files: one for every row (name, content), for images, cards and manifests.

    spark.dataSource.register(FileSink)
    files.write.format("tessera_files").option("path", folder).mode("append").save()

Tasks write under names of their own, which become the files' when the whole write is committed; an aborted or repeated
task leaves nothing.  `folder` is a path that all executors and the driver share; names stay within it, and of equal names
the last one committed wins.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = os.path.abspath(folder.removeprefix("file://"))

    def target(self, name: str) -> str:
        path = os.path.abspath(os.path.join(self.folder, name))
        if not name or not path.startswith(self.folder + os.sep):
            raise ValueError(f"{name!r} is not a name within the folder")
        return path

    def write(self, iterator: Iterator) -> Written:
        out = Written()
        for row in iterator:
            path = self.target(row["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"] or b"")
            out.files.append((part, path))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, path in m.files if m else []:
                os.replace(part, path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, _ in m.files if m else []:
                if os.path.exists(part):
                    os.remove(part)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])
