"""Versioned outputs that become visible together with the watermark they were made up to.

A commit is one small JSON file in `<root>/commits`, renamed into place without overwriting. Data files are written first
into a folder of their own; a folder that no commit names is not part of the table. So a run that dies leaves no trace
that a reader sees, and of two runs that race for one version only one can win. The root must be on a file system whose rename
without overwriting is atomic (HDFS, POSIX); plain object stores give no such rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another run has committed this version."""


@dataclass(frozen=True)
class Commit:
    version: int
    watermark: dict[str, Any]
    data: str | None
    info: dict[str, Any] = field(default_factory=dict)


class Ledger:
    """The commits under root; root is on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _name(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commits(self) -> list[Commit]:
        return [Commit(**json.loads(self._read(f"{self.root}/commits/{n}"))) for n in self._names()]

    def _names(self) -> list[str]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        return [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def latest(self) -> Commit | None:
        """The last commit; names are listed, only its own file is read."""
        names = self._names()
        return Commit(**json.loads(self._read(f"{self.root}/commits/{names[-1]}"))) if names else None

    def folder(self) -> str:
        """A new folder that no commit names yet."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def stage(self, df: DataFrame) -> str:
        """Writes df into a folder that no commit names yet."""
        data = self.folder()
        df.write.option("compression", "zstd").parquet(data)
        return data

    def put(self, folder: str, name: str, df: DataFrame) -> DataFrame:
        """Writes one of several tables into a folder that is to be committed, and reads it back."""
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def part(self, commit: Commit, name: str) -> DataFrame:
        """One of the tables of a commit whose data has several."""
        return self.spark.read.parquet(f"{commit.data}/{name}")

    def commit(self, after: Commit | None, watermark: dict[str, Any], data: str | None, **info: Any) -> Commit:
        """Makes data and watermark visible in one step; CommitConflict if `after` is no longer the latest commit."""
        new = Commit((after.version if after else 0) + 1, watermark, data, info)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        draft = f"{self.root}/commits/_{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        try:
            context.rename(self._path(draft), self._path(self._name(new.version)), options)
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            if self._fs.exists(self._path(self._name(new.version))):
                raise CommitConflict(f"version {new.version} of {self.root} is taken") from e
            raise
        return new

    def read(self, schema=None) -> DataFrame | None:
        """All committed data; None before the first commit with data."""
        paths = [c.data for c in self.commits() if c.data]
        if not paths:
            return None
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*paths)
