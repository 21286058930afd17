"""The few file operations that the store needs, on whatever file system Spark reads."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from typing import Any

from pyspark import SparkContext
from pyspark.sql import SparkSession

from strandgrid.plans.errors import QueryError


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a session on one machine takes that machine's temporary folder; a cluster has to name a folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            root = given.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            root = f"{tempfile.gettempdir()}/checkpoints"
        else:
            raise QueryError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> str:
    """Let a folder go when the application ends; it is made if it isn't there."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder now."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(name))) if self.exists(name) else []

    def older(self, name: str, seconds: float) -> list[str]:
        """The names in a folder that were changed last before so many seconds."""
        if not self.exists(name):
            return []
        until = time.time() - seconds
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(name)) if s.getModificationTime() / 1000 <= until)

    def read(self, name: str) -> Any:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def create(self, name: str, value: Any) -> bool:
        """Write a new file; False if another writer has made it already."""
        fs, final = self._fs(), self._path(name)
        if fs.exists(final):
            return False
        draft = self._path(f"{name}.{self.jvm.java.util.UUID.randomUUID()}.tmp")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(value, indent=1).encode()))
        stream.close()
        # a rename onto a file that exists is refused: the first writer wins
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        try:
            context.rename(draft, final, self._no_options())
            return True
        except Exception as error:
            if fs.exists(final):
                fs.delete(draft, False)
                return False
            raise error

    def _no_options(self):
        """An empty Java array: rename without overwriting."""
        return SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)
