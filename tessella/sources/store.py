"""The provenance store: one Parquet table for each schema, in snapshots.

A batch writes changed tables to a new snapshot folder and then records the snapshot's name, so
readers see all of a batch or nothing. Tables that a batch doesn't touch stay where they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMA_VERSION, TABLES


class Store:
    """Tables below ``path``, a URI that Spark reads; missing tables are empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: dict[str, DataFrame] | None = None

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def places(self) -> dict[str, str]:
        """table: folder, as of the last committed batch."""
        files, at = self._hadoop(f"{self.path}/_snapshots")
        if not files.exists(at):
            return {}
        log = self.spark.read.schema("n long, name string, folder string").json(f"{self.path}/_snapshots")
        latest = log.groupBy("name").agg(F.max_by("folder", "n").alias("folder"))
        return {r["name"]: r["folder"] for r in latest.collect()}  # a row for each table

    def read(self, name: str) -> DataFrame:
        """A table; columns that older files lack are null."""
        if self._pending and name in self._pending:
            return self._pending[name]
        place = self.places().get(name)
        ddl = TABLES[name][1]
        if place is None:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(place)

    def begin(self) -> None:
        if self._pending is not None:
            raise RuntimeError("a batch is open")
        self._pending = {}

    def put(self, name: str, table: DataFrame) -> None:
        """Replaces a table: in the open batch, or at once."""
        columns = [c.split()[0] for c in TABLES[name][1].split(", ")]
        alone = self._pending is None
        if alone:
            self.begin()
        self._pending[name] = table.select(*columns)
        if alone:
            self.commit()

    def commit(self) -> None:
        if self._pending is None:
            raise RuntimeError("no batch is open")
        files, at = self._hadoop(f"{self.path}/_snapshots")
        n = len(self.places()) and self.spark.read.schema("n long").json(f"{self.path}/_snapshots").agg(F.max("n")).first()[0] + 1
        rows = []
        for name, table in self._pending.items():
            folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
            table.write.parquet(folder)
            rows.append((n, name, folder))
        self._pending = None
        if rows:
            self.spark.createDataFrame(rows, "n long, name string, folder string").coalesce(1).write.mode("append").json(f"{self.path}/_snapshots")

    def rollback(self) -> None:
        self._pending = None

    def clear(self) -> None:
        """Empties all tables but the schema version."""
        self.begin()
        for name, (_, ddl) in TABLES.items():
            rows = [("schema_version", SCHEMA_VERSION)] if name == "provenance_meta" else []
            self.put(name, self.spark.createDataFrame(rows, ddl))
        self.commit()
