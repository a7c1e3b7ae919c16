"""Versioned Parquet storage: immutable directories for tables and graphs, and one catalogue file that points to them.

A statement reads the directories that the catalogue named when it began; a write makes new directories and then
swaps the catalogue by a rename, so readers see all of a change or none of it.  Files are reached through Hadoop's
file systems, so the folder may be on any store that Spark can write.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EMPTY = {"version": 0, "tables": {}, "graphs": {}, "indexes": {}}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def catalogue(self) -> dict:
        """The current catalogue, which is small: names, schemas and directories."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        versions = sorted(n for n in names if n.startswith("catalogue-") and n.endswith(".json"))
        if not versions:
            return copy.deepcopy(EMPTY)
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/{versions[-1]}", wholetext=True).collect()))

    def publish(self, catalogue: dict) -> dict:
        """Write catalogue as the next version; fails if another writer was faster."""
        new = copy.deepcopy(catalogue)
        new["version"] += 1
        target, draft = self._path(f"catalogue-{new['version']:09d}.json"), self._path(f".draft-{uuid.uuid4().hex}")
        if self._fs.exists(target):
            raise RuntimeError("another writer published first")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer published first")
        return new

    def write(self, df: DataFrame, name: str) -> str:
        """A new directory with df's rows; nothing refers to it until it is published."""
        place = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        return place

    def read(self, places: list[str], schema: T.StructType) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)
