"""Files in the shared folder, through Hadoop's file systems: what Spark can open, these can."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def data_files(self, folder: str) -> list[tuple[str, int]]:
        """(name below the root, bytes) of the data files that Spark wrote into a folder."""
        found = self._fs.listStatus(self._path(folder))
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in found if s.getPath().getName().startswith("part-"))

    def read_json(self, name: str):
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit_json(self, name: str, value: object) -> bool:
        """Write value under a name that must be new, whole or not at all; False if the name was taken."""
        final, draft = self._path(name), self._path(f"drafts/{uuid.uuid4().hex}")
        if self._fs.exists(final):
            return False
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(draft).toUri(), self._conf)
        try:
            # Without an option to overwrite, a rename onto a name that exists fails.
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
