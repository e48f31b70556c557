"""Small numbered records in a shared folder, and keyed tables whose versions are such records.

A record is written under another name and renamed, so a reader sees all of it or nothing, and a number is taken once.
A table's version names the folders that make it up: a write adds a folder and then the record; one that fails before
the record leaves the version before as it was, and what it wrote is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Records by number in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        """The numbers that have a record, in order."""
        top = self._path(self.at)
        if not self._fs.exists(top):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def get(self, number: int) -> dict:
        held = self._fs.open(self._path(f"{self.at}/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def last(self, before: int | None = None) -> tuple[int, dict] | None:
        """The newest record, or the newest below a number."""
        known = [n for n in self.numbers() if before is None or n < before]
        return (known[-1], self.get(known[-1])) if known else None

    def put(self, number: int, record: dict, replace: bool = False) -> None:
        """Writes a record; a number that is taken is an error unless it is to be replaced."""
        to = self._path(f"{self.at}/{number:012d}.json")
        draft = self._path(f"{self.at}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if replace:
            self._fs.delete(to, False)
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise FileExistsError(f"record {number} at {self.at}")

    def delete(self, numbers: list[int]) -> None:
        for n in numbers:
            self._fs.delete(self._path(f"{self.at}/{n:012d}.json"), False)


class KeyedTable:
    """A table with one row for each key, the newest by a column; changes are added as folders and merged now and then."""

    def __init__(self, spark: SparkSession, at: str, schema: str, keys: list[str], order: str, merge_after: int = 8):
        self.spark, self.at, self.schema, self.keys, self.order, self.merge_after = spark, at.rstrip("/"), schema, keys, order, merge_after
        self.versions = Ledger(spark, f"{self.at}/versions")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; none before the first write."""
        found = self.versions.last() if version is None else (version, self.versions.get(version))
        return self._rows(found[1]["parts"] if found else [])

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.at}/data/{p}" for p in parts])
        return rows if len(parts) == 1 else self._newest(rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *[c for c in rest if c != self.order])).alias("b"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"b.{c}").alias(c) for c in rows.columns])

    def upsert(self, rows: DataFrame, before_commit: Callable[[], None] | None = None) -> int:
        """Adds rows, the newest of each key, as the next version; returns its number. Two writers can't take one number."""
        found = self.versions.last()
        number, parts = (found[0] + 1, found[1]["parts"]) if found else (0, [])
        names = [c.split()[0] for c in self.schema.split(", ")]
        new = self._newest(rows.select(*names))
        part = uuid.uuid4().hex
        if len(parts) >= self.merge_after:
            new, parts = self._newest(self._rows(parts).unionByName(new)), []
        new.write.parquet(f"{self.at}/data/{part}")
        if before_commit:
            before_commit()
        self.versions.put(number, {"parts": [*parts, part]})
        return number
