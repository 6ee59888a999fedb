"""A table in buckets of a key's hash, of which a batch rewrites only those that it touches."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mediaframe.operators.generation import stable
from mediaframe.plans.lineage import cut_lineage
from mediaframe.sources.catalog import upsert
from mediaframe.sources.pointers import Pointers

ATTEMPTS, KEEP = 3, 3
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Unstable(RuntimeError):
    """What was to be committed went stale at each attempt."""


@dataclass
class Staged:
    """Buckets written for a commit after pointer `after`, which no reader sees yet."""
    after: int
    folder: str
    pointer: dict
    old: DataFrame
    new: DataFrame


class BucketStore:
    """Rows of distinct keys in `buckets` parts by the key's hash, each in a folder that is never changed.

    The last pointer lists each bucket's folder, the schema, and for each stream that wrote here the
    number of its last batch. Reads see one pointer's rows throughout. `keep` pointers and what they name
    stay. A bucket is rewritten by one task: choose so many that it fits.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "media_id", buckets: int = 16, keep: int = KEEP):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path, key, buckets, keep
        self.pointers = Pointers(spark, f"{path}/_pointer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, pointer: dict, buckets: list[str] | None, schema: StructType) -> DataFrame:
        folders = [f"{self.path}/{v}" for b, v in sorted(pointer.get("buckets", {}).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        _, pointer = self.pointers.last()
        if not pointer:
            raise FileNotFoundError(f"nothing is stored at {self.path}")
        return self._rows(pointer, None, StructType.fromJson(pointer["schema"]))

    def known(self, writer: str, number: int) -> bool:
        """Whether this batch of this stream is in the store."""
        return self.pointers.last()[1].get("writers", {}).get(writer, -1) >= number

    def stage(self, batch: DataFrame, merge: Merge, writer: str | None = None, number: int | None = None) -> Staged:
        """Writes the buckets that `batch` touches as `merge(their rows, batch)` leaves them."""
        after, pointer = self.pointers.last()
        touched = [str(r[0]) for r in batch.select(self._bucket()).distinct().collect()]  # at most one a bucket
        old = self._rows(pointer, touched, batch.schema)
        new = merge(old, batch)
        folder = f"data/{after + 1:020}-{uuid.uuid4().hex[:12]}"
        new.withColumn("_bucket", self._bucket()).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        held = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self.pointers.names(f"{self.path}/{folder}") if n.startswith("_bucket=")}
        buckets = {b: v for b, v in pointer.get("buckets", {}).items() if b not in touched} | held
        writers = pointer.get("writers", {}) | ({} if writer is None else {writer: number})
        return Staged(after, folder, {"buckets": buckets, "schema": batch.schema.jsonValue(), "writers": writers}, old, self._rows({"buckets": held}, None, batch.schema))

    def commit(self, staged: Staged) -> bool:
        """Lets readers see what is staged; False, and nothing seen, if another commit came between."""
        if not self.pointers.advance(staged.after, staged.pointer):
            return False
        self.pointers.trim(self.keep)
        used = {v for n in self.pointers.numbers() for v in self.pointers.read(n)["buckets"].values()}
        oldest = min(self.pointers.numbers())
        for folder in self.pointers.names(f"{self.path}/data"):
            if int(folder.split("-")[0]) < oldest:  # no writer is at work there
                parts = [p for p in self.pointers.names(f"{self.path}/data/{folder}") if f"data/{folder}/{p}" in used]
                for p in [] if parts else [folder]:
                    self.pointers.remove(f"{self.path}/data/{p}")
                for p in set(self.pointers.names(f"{self.path}/data/{folder}")) - set(parts) if parts else ():
                    self.pointers.remove(f"{self.path}/data/{folder}/{p}")
        return True

    def discard(self, staged: Staged) -> None:
        self.pointers.remove(f"{self.path}/{staged.folder}")

    def fold(self, batch: DataFrame, merge: Merge, writer: str | None = None, number: int | None = None, seen: Callable[[Staged], None] | None = None, attempts: int = ATTEMPTS) -> bool:
        """Merges a batch; False if this batch of this stream is in already. Another writer's commit between makes it start again, `attempts` times.

        `seen` is given what is staged before the commit.
        """
        for _ in range(attempts):
            if writer is not None and self.known(writer, number):
                return False
            staged = self.stage(batch, merge, writer, number)
            if seen is not None:
                seen(staged)
            if self.commit(staged):
                return True
            self.discard(staged)
        raise Unstable(f"{attempts} commits of others came between")

    def upsert(self, changes: DataFrame) -> None:
        """Inserts or replaces rows by key; `changes` has each key once."""
        self.fold(changes, lambda old, new: upsert(old, new, [self.key]))

    def scan(self, states: Callable[[], DataFrame], changed: Callable[[DataFrame], DataFrame], merge: Merge, attempts: int = ATTEMPTS) -> int:
        """Commits what `changed(states)` finds, if neither the volumes' states (volume, version, generation) nor the store moved meanwhile; else starts again.

        Returns the attempts it took. After `attempts` all is discarded and it is an error: no row, absence or checkpoint is left.
        """
        for attempt in range(1, attempts + 1):
            start = cut_lineage(states())
            staged = self.stage(changed(start), merge)
            if stable(start, states()).first()["stable"] and self.commit(staged):
                return attempt
            self.discard(staged)
        raise Unstable("the volumes did not hold still")
