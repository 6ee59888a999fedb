"""A log of small JSON pointers, to which a writer can add only what follows the one it has read."""
from __future__ import annotations

import json

from pyspark.sql import SparkSession

from mediaframe.plans.lineage import remove_folder


class Pointers:
    """Numbered pointers in a folder. The last one counts; none is ever changed.

    A pointer's file is created under its number and only if there is none, which HDFS and local folders
    grant; of two writers that follow the same pointer one succeeds. On object stores without
    that, there must be one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing, if there is none."""
        fs, at = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def remove(self, path: str) -> None:
        remove_folder(self.spark, path)

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names(self.path) if n.endswith(".json")]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{number:020}.json", wholetext=True).first()[0])

    def last(self) -> tuple[int, dict]:
        """The last number and pointer; (0, {}) if there is none. A pointer still being written is an error to read."""
        number = max(self.numbers(), default=0)
        return (number, self.read(number)) if number else (0, {})

    def advance(self, after: int, pointer: dict) -> bool:
        """Adds a pointer after number `after`; False if another writer has done so."""
        if max(self.numbers(), default=0) != after:
            return False
        fs, at = self._at(f"{self.path}/{after + 1:020}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:  # FileAlreadyExistsException, in the words of each file system
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        finally:
            out.close()
        return True

    def trim(self, keep: int) -> None:
        """Removes all but the last `keep` pointers."""
        for number in self.numbers()[:-keep]:
            self.remove(f"{self.path}/{number:020}.json")
