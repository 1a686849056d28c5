"""Tables whose upserts readers see whole: files are never changed, and a snapshot, one small file, says which of them are the table.

    table = SnapshotTable(spark, path)
    stream.writeStream.foreachBatch(upsert_snapshots(path, keys)).option("checkpointLocation", ...).start()
    table.read(), table.read(days=("2024-01-01", "2024-01-31")), table.read(version=7)

A commit writes the days that it touches into a folder of its own, then a snapshot that names the folder of every day, and puts
that in place by one rename, which fails if another writer was first. A reader between any two steps sees the table
before or after, never between. Snapshots keep each writer's last batch number, so a batch that is run again is skipped.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import upsert_points


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


@dataclass
class Snapshot:
    version: int = -1
    #: The folder of each day's rows, below the table's path.
    days: dict[str, str] = field(default_factory=dict)
    #: The last batch of each writer.
    batches: dict[str, int] = field(default_factory=dict)
    schema: str = ""


class SnapshotTable:
    """One row a day and snapshot is what the driver holds, whatever the number of rows."""

    def __init__(self, spark: SparkSession, path: str, day: str = "local_day"):
        self.spark, self.path, self.day = spark, path.rstrip("/"), day

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where, system = self._at(folder)
        return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:12]) for n in self._names("_snapshots") if re.fullmatch(r"\d{12}\.json", n))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or that of a version; an empty one for a table without any."""
        known = self.versions()
        if version is None and not known:
            return Snapshot()
        number = known[-1] if version is None else version
        where, system = self._at(f"_snapshots/{number:012}.json")
        stream = system.open(where)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Snapshot(number, **json.loads(text))

    def read(self, version: int | None = None, days: tuple[str, str] | None = None) -> DataFrame | None:
        """The table as of a snapshot, or its days of a range (both ends included); None while it has no schema."""
        seen = self.snapshot(version)
        return self._rows(seen, [at for d, at in sorted(seen.days.items()) if days is None or days[0] <= d <= days[1]])

    def _rows(self, seen: Snapshot, folders: Sequence[str]) -> DataFrame | None:
        if not seen.schema:
            return None
        schema = StructType.fromJson(json.loads(seen.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{at}" for at in folders)) if folders else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, base: Snapshot, removed: Sequence[str] = (), writer: str = "", batch: int | None = None) -> Snapshot:
        """Replaces the days that `rows` have, drops those in `removed`, keeps all others of `base`. Raises Conflict if base is no longer the newest."""
        folder = f"data/{uuid.uuid4().hex}"
        name = F.coalesce(F.col(self.day).cast("string"), F.lit("none"))  # a null day has a folder as well
        rows.withColumn("__day", name).repartition("__day").write.option("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS").partitionBy("__day").parquet(f"{self.path}/{folder}")
        touched = {self._unescape(n[6:]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("__day=")}
        kept = {d: at for d, at in base.days.items() if d not in removed}
        batches = base.batches | ({writer: batch} if batch is not None else {})
        schema = json.dumps(rows.schema.jsonValue())
        return self._switch(Snapshot(base.version + 1, kept | touched, batches, schema))

    def _unescape(self, name: str) -> str:
        """Folder names of partitions have special characters as %XX."""
        return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name)

    def _switch(self, new: Snapshot) -> Snapshot:
        beside, system = self._at(f"_snapshots/.{uuid.uuid4().hex}")
        out = system.create(beside, False)
        out.write(bytearray(json.dumps({"days": new.days, "batches": new.batches, "schema": new.schema}).encode()))
        out.close()
        final, _ = self._at(f"_snapshots/{new.version:012}.json")
        if system.exists(final) or not system.rename(beside, final):
            system.delete(beside, False)
            raise Conflict(f"version {new.version} of {self.path} is another writer's")
        return new

    def upsert(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), writer: str = "", batch: int | None = None, tries: int = 5) -> Snapshot:
        """Merges rows field by field into the days that they touch (upsert_points). A batch that the table has from this writer is skipped."""
        for left in range(tries, 0, -1):
            base = self.snapshot()
            if batch is not None and base.batches.get(writer, -1) >= batch:
                return base
            name = F.coalesce(F.col(self.day).cast("string"), F.lit("none"))
            touched = {r[0] for r in rows.select(name).distinct().collect()}  # days, not rows
            old = self._rows(base, [at for d, at in base.days.items() if d in touched])
            try:
                return self.commit(upsert_points(rows.limit(0) if old is None else old, rows, [*dict.fromkeys([*keys, self.day])], order), base, (), writer, batch)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def delete_days(self, days: Sequence[str]) -> Snapshot:
        base = self.snapshot()
        empty = self._rows(base, [])
        return base if empty is None else self.commit(empty, base, days)

    def clean(self, keep: int = 3) -> int:
        """Removes snapshots but the newest `keep`, and folders that none of those names; the number of folders removed. Not while a commit is under way."""
        known = self.versions()
        used = {at.split("/")[1] for v in known[-keep:] for at in self.snapshot(v).days.values()}
        for v in known[:-keep]:
            where, system = self._at(f"_snapshots/{v:012}.json")
            system.delete(where, False)
        unused = [n for n in self._names("data") if n not in used]
        for n in unused:
            where, system = self._at(f"data/{n}")
            system.delete(where, True)
        return len(unused)


def upsert_snapshots(path: str, keys: Sequence[str], day: str = "local_day", order: Sequence[str] = (), writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is one commit, made once however often it is run."""

    def work(batch: DataFrame, number: int) -> None:
        SnapshotTable(batch.sparkSession, path, day).upsert(batch, keys, order, writer, number)

    return work
