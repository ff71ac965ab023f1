"""Small files and folders of a table, through the file system its path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """What a driver asks a store about a table: names, sizes, and short texts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        # Each step of a name asks the JVM, so it is looked up once.
        self.path_class = self.jvm.org.apache.hadoop.fs.Path
        self.root = self.path(root)
        self.store = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        found = self.path_class(parts[0])
        for part in parts[1:]:
            found = self.path_class(found, part)
        return found

    def under(self, *parts: str):
        found = self.root
        for part in parts:
            found = self.path_class(found, part)
        return found

    def exists(self, *parts: str) -> bool:
        return self.store.exists(self.under(*parts))

    def statuses(self, *parts: str) -> dict[str, object]:
        """Name to status of what a folder holds; nothing for a folder that is not there."""
        folder = self.under(*parts)
        if not self.store.exists(folder):
            return {}
        return {status.getPath().getName(): status for status in self.store.listStatus(folder)}

    def size(self, *parts: str) -> int:
        return sum(status.getLen() for status in self.statuses(*parts).values() if status.isFile())

    def read(self, *parts: str) -> str:
        stream = self.store.open(self.under(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """Write a text so that a reader finds all of it or nothing."""
        whole = self.under(*parts)
        draft = self.under(*parts[:-1], f"_{uuid.uuid4().hex}")
        stream = self.store.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.store.exists(whole):
            self.store.delete(whole, False)
        if not self.store.rename(draft, whole):
            raise OSError(f"cannot rename {draft} to {whole}")

    def delete(self, *parts: str) -> None:
        self.store.delete(self.under(*parts), True)
