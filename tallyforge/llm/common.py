"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: DuckDB's SQL has no crc32: bit by bit over the bytes of an ASCII text ``{s}``.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({s}, ''), lambda ch: ord(ch)::UBIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"""

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder stands in if the master is local
    (one machine, as in tests) and goes when the interpreter ends; on a cluster it is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Lets Spark drop the shuffle files of what runs in the block when it has ended, not when
    the driver happens to collect its garbage: what is written needs them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage so that a lost executor costs a re-read, freezes values such as
    row numbers, and keeps columns prunable, which ``checkpoint()`` does not.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Staged tables that go when the block ends; what leaves it must be staged elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.paths.append(path)
        return out

    def bucketed(self, df: DataFrame | Iterable[DataFrame], name: str, key: str) -> DataFrame:
        """Like ``staged``, dealt by ``key``: grouping and joining by it move these rows no more.
        Several tables of the same columns are written one after another, into one."""
        some = iter([df] if isinstance(df, DataFrame) else df)
        df = next(some)
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{table}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{key}`) INTO {parts} BUCKETS LOCATION '{path}'")
        with shuffles_freed(self.spark):  # an insert into the table, whose shuffles Spark knows, unlike those of a save as table
            for part in itertools.chain([df], some):
                part.write.insertInto(table)
        self.tables.append(table)
        self.paths.append(path)
        return self.spark.table(table)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def clear(self) -> None:
        """Deletes all that was staged so far."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths, self.tables = [], []


def numbered(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells rows of equal ids apart, null ids too.
    Row numbers are frozen by writing the table; it is not written if no id repeats."""
    ids = docs.groupBy(F.col(f"`{id_col}`")).count()
    if ids.where("count > 1").isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def may_be_among(rows: DataFrame, key: str, ids: DataFrame, slots: int = 1 << 24) -> DataFrame:
    """The rows whose ``key``, a number, shares a hash slot with one of ``ids``, a table of its
    own ``key``: all whose ``key`` is among them, and few others as long as slots are free.  No row moves."""
    slot = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(29)), F.lit(slots))
    bit = F.expr("shiftleft(1L, CAST(__slot & 63 AS INT))")
    of = lambda rows: rows.withColumn("__slot", slot).withColumn("__w", F.shiftright("__slot", 6))
    taken = of(ids.select(key)).groupBy("__w").agg(F.bit_or(bit).alias("__bits"))
    return of(rows).join(F.broadcast(taken), "__w").where(F.col("__bits").bitwiseAND(bit) != 0).select(*rows.columns)


def dense_positions(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the order of ``order``, written out.

    Rows are dealt by ranges of ``order`` and sorted there; the first place of each range
    comes from the counts of the ranges before it, a row per writing task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = scratch.staged(cut.withColumn(name, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(name, 33)
    sizes = sorted(cut.groupBy(part.alias("part")).count().collect())
    starts = itertools.accumulate((r["count"] for r in sizes), initial=0)
    first = spark.createDataFrame([(r["part"], start) for r, start in zip(sizes, starts)], "part long, first long")
    told = cut.withColumn("part", part).join(F.broadcast(first), "part")
    return told.withColumn(name, F.col("first") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]``; none for null or blank text."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)),
    )


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def without(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``df`` but those an operator is about to write."""
    return [F.col(f"`{c}`") for c in df.columns if c not in names]
