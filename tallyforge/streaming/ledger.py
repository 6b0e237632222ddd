"""A sink that a batch enters once, whatever crashes.

A batch goes to a folder of its own, named by query and batch number, and is written
over if it comes again; its entry in the ledger comes last.  Readers see what the ledger
names.  So a batch that is replayed after a crash adds nothing, and one that was cut off
is never seen in part.  An entry that cannot be read is set aside and its batch counts
as not written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def _entries(spark: SparkSession, path: str) -> dict[tuple[str, int], dict]:
    out = {}
    for name in store.names(spark, f"{path}/ledger"):
        if not name.endswith(".json"):
            continue
        text = store.read(spark, f"{path}/ledger/{name}")
        try:
            entry = json.loads(text)
            out[entry["query"], int(entry["batch"])] = entry
        except (ValueError, KeyError, TypeError):
            store.move(spark, f"{path}/ledger/{name}", f"{path}/ledger/{name}.corrupt")
    return out


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches that the ledger names, with ``query`` and ``batch``."""
    there = sorted(_entries(spark, path))
    folders = [f"{path}/rows/query={q}/batch={b}" for q, b in there]
    if not folders:
        return spark.createDataFrame([], schema).withColumns({"query": F.lit(None).cast("string"), "batch": F.lit(None).cast("long")})
    return spark.read.option("basePath", f"{path}/rows").parquet(*folders).withColumn("batch", F.col("batch").cast("long"))


def once_into(path: str, query: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes each batch of ``query`` once.  With ``key``,
    rows whose key an earlier batch brought, or that repeat one, are left out."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entries = _entries(spark, path)
        if (query, number) in entries:
            return
        if key is not None:
            batch = batch.dropDuplicates([key])
            if entries:
                batch = batch.join(committed(spark, path, batch.schema).select(key), key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{path}/rows/query={query}/batch={number}")
        store.write(spark, f"{path}/ledger/{query}-{number}.json", json.dumps({"query": query, "batch": number}))

    return write
