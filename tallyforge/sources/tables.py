"""A keyed table that is merged into, and read whole at any time.

Rows are dealt into buckets by their key.  A merge rewrites the buckets that hold keys of
its updates, into a folder of its own, and then names them in a new version: a small
file that says in which folder each bucket lies.  Readers take the last version, so they
see all of a merge or nothing, and a merge that fails leaves no trace.  Two merges at
once cannot both become the same version; the later one raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import latest_state
from . import store


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in store.names(self.spark, f"{self.path}/versions") if n.endswith(".json"))

    def _version(self) -> tuple[int, dict]:
        last = self._versions()
        if not last:
            return 0, {"buckets": {}, "done": []}
        return last[-1], json.loads(store.read(self.spark, f"{self.path}/versions/{last[-1]:08d}.json"))

    def _rows(self, version: dict, only: list[int] | None = None) -> DataFrame | None:
        at = [f"{self.path}/rows/{folder}/__bucket={b}" for b, folder in version["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.option("mergeSchema", "true").parquet(*at) if at else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of an earlier one; None before the first merge."""
        told = self._version()[1] if version is None else json.loads(store.read(self.spark, f"{self.path}/versions/{version:08d}.json"))
        return self._rows(told)

    def merge(self, updates: DataFrame, at: str, mark: str | None = None) -> int:
        """Per key the row with the latest ``at`` stays.  Returns the version.  A merge whose
        ``mark`` (a query and batch, say) was merged before changes nothing."""
        number, version = self._version()
        if mark is not None and mark in version["done"]:
            return number
        told = latest_state(updates, self.key, [at]).withColumn("__bucket", self._bucket())
        touched = [r[0] for r in told.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        if touched:
            current = self._rows(version, touched)
            if current is not None:
                told = latest_state(told.unionByName(current.withColumn("__bucket", self._bucket()), allowMissingColumns=True), self.key, [at])
            folder = uuid.uuid4().hex
            told.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/rows/{folder}")
            version["buckets"] |= {str(b): folder for b in touched}
        version["done"] = [*version["done"], mark][-1000:] if mark is not None else version["done"]
        if not store.write(self.spark, f"{self.path}/versions/{number + 1:08d}.json", json.dumps(version)):
            raise RuntimeError(f"version {number + 1} of {self.path} was written by another merge")
        return number + 1
