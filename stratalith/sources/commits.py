"""A log of commits in a shared folder: numbered JSON files that appear whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Each commit is written under another name and then renamed without overwriting, so that a reader never sees half of one.

    A writer that dies before that leaves nothing a reader looks at; of two writers of
    one number the second fails. An empty file, left by other means, is no commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.conf, self.path = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.at = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.at(self.path).getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        there = self.fs.listStatus(self.at(self.path)) if self.fs.exists(self.at(self.path)) else []
        named = [s.getPath().getName().removesuffix(".json") for s in there if s.getLen() and s.getPath().getName().endswith(".json")]
        return sorted(int(n) for n in named if n.isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, what it says) of a commit, the last one if none is given; -1 and nothing if there is none."""
        if number is None:
            done = self.numbers()
            if not done:
                return -1, {}
            number = done[-1]
        stream = self.fs.open(self.at(f"{self.path}/{number}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, told: dict) -> None:
        """Raises if another writer has made this commit."""
        name = f"{self.path}/.{number}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(name), False)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        end = self.at(f"{self.path}/{number}.json")
        if self.fs.exists(end) and not self.fs.getFileStatus(end).getLen():
            self.fs.delete(end, False)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(self.path).toUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        whole = lambda p: self.fs.makeQualified(self.at(p))
        try:
            context.rename(whole(name), whole(f"{self.path}/{number}.json"), self.gateway.new_array(rename, 0))
        except Exception:
            self.fs.delete(self.at(name), False)
            raise

    def forget(self, number: int) -> None:
        self.fs.delete(self.at(f"{self.path}/{number}.json"), False)
