"""A log of commits below a folder that driver and executors share: numbered JSON files, each put there once.

Writers put their files in folders of their own and then name them in a commit. What no commit names is not seen. A file
becomes visible whole, by a rename that fails where the number is taken, so of two writers one has to look again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed what this one was about to."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self) -> object:
        return self._at(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, at = self._files(), self._at(self.path)
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._files().open(self._at(f"{self.path}/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """Commits in order, each with its version."""
        return [self.read(v) | {"version": v} for v in self.versions()]

    def put(self, version: int, entry: dict) -> bool:
        """Whether the commit is there now; False if the version was taken."""
        fs, new = self._files(), f"{self.path}/.{uuid.uuid4().hex}"
        stream = fs.create(self._at(new), False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(self._at(new), self._at(f"{self.path}/{version:020d}.json"), self._no_options())
        except Py4JJavaError as e:
            fs.delete(self._at(new), False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _no_options(self) -> object:
        from pyspark import SparkContext

        gateway = SparkContext._active_spark_context._gateway
        return gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def delete(self, path: str) -> None:
        self._files().delete(self._at(path), True)

    def folders(self, path: str) -> list[str]:
        fs, at = self._files(), self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
