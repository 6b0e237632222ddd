"""Comparing and combining tables and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..sources import shared


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; a column that a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sheet_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as text, that one table has more often than the other, as often as they are over:
    one signed count, combined before its only shuffle."""
    text = lambda t, n: t.select(*[F.col(c).cast("string") for c in a.columns], F.lit(n).alias("__n"))
    g = text(a, 1).unionByName(text(b, -1)).groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "left").otherwise("right")
    return g.select(*a.columns, side.alias("side"), F.explode(F.array_repeat(F.lit(1), F.abs("__n").cast("int"))).alias("__k")).drop("__k")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows as sets and as multisets."""
    ga, gb = (t.groupBy(*a.columns).agg(F.count("*").alias(n)) for t, n in ((a, "na"), (b, "nb")))
    cond = reduce(lambda x, y: x & y, [ga[c].eqNullSafe(gb[c]) for c in a.columns])
    j = ga.join(gb, cond, "full").select("na", "nb")
    return j.agg(F.coalesce(F.bool_and(F.col("na").isNotNull() & F.col("nb").isNotNull()), F.lit(True)).alias("same_set"), F.coalesce(F.bool_and(F.coalesce(F.col("na") == F.col("nb"), F.lit(False))), F.lit(True)).alias("same_multiset"))


def record_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Added, removed and changed values by key and path."""
    flat = lambda t: t.unpivot(keys, [F.col(c).cast("string").alias(c) for c in columns], "path", "value").where("value IS NOT NULL")
    o, n = flat(old).withColumnRenamed("value", "old"), flat(new).withColumnRenamed("value", "new")
    j = o.join(n, [*keys, "path"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "path", "old", "new", kind.alias("kind"))


def distinct_list(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The distinct values of each key, sorted, in one text."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(name))


def leaves(schema: StructType, prefix: str = "") -> list[str]:
    """The paths of all fields of nested structs that are no structs themselves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, path + ".") if isinstance(f.dataType, StructType) else [path]
    return out


def nested_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``record_diff`` of nested records: structs are gone into, lists are compared by place."""

    def elements(p: str, kind: ArrayType) -> Column:
        text = lambda x: F.to_json(x) if isinstance(kind.elementType, (StructType, ArrayType)) else x.cast("string")
        place = lambda i: F.concat(F.lit(p + "["), i.cast("string"), F.lit("]"))
        return F.transform(F.coalesce(F.col(p), F.array().cast(kind)), lambda x, i: F.struct(place(i).alias("path"), text(x).alias("value")))

    def flat(t: DataFrame) -> DataFrame:
        parts = []
        for p in leaves(t.drop(key).schema):
            kind = reduce(lambda s, n: s[n].dataType, p.split("."), t.schema)
            parts.append(elements(p, kind) if isinstance(kind, ArrayType) else F.array(F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value"))))
        return t.select(key, F.inline(F.concat(*parts))).where("value IS NOT NULL")

    o, n = flat(old).withColumnRenamed("value", "old"), flat(new).withColumnRenamed("value", "new")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return o.join(n, [key, "path"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "path", "old", "new", kind.alias("kind"))


def sorted_union(tables: list[DataFrame]) -> DataFrame:
    """The distinct values of one-column tables."""
    return reduce(lambda a, b: a.union(b), tables).distinct()


def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many rows each key has."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """(pairs, repeated): different keys without a null, and rows whose key is not their own alone."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    g = counted(df, keys, "n")
    return g.agg(F.count_if(known).alias("pairs"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("repeated"))


def json_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, old, new): how the JSON object ``text`` of each key differs, whatever
    its form.  Objects are gone into; what is there on one side only is added or removed
    as a whole, at its topmost path; lists and all else are compared as values, numbers by
    what they amount to.  Keys that either table lacks, and texts that are no objects, count
    as empty objects.

    Each level is one join by (key, path), then a written table; there are as many as the
    objects are deep.
    """
    spark = old.sparkSession
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    shown = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))

    def fields(pairs: DataFrame, side: str) -> DataFrame:
        e = pairs.where(is_object(F.col(side))).lateralJoin(spark.tvf.variant_explode(F.col(side).outer()))
        return e.select("k", F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("value").alias(side))

    parse = lambda t, side: t.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(text).alias(side))
    pairs, out = parse(old, "a").join(parse(new, "b"), ["k", "path"], "full"), []
    while True:
        level = shared.written(fields(pairs, "a").withColumn("ina", F.lit(True)).join(fields(pairs, "b").withColumn("inb", F.lit(True)), ["k", "path"], "full"), "json-level")
        deeper = is_object(F.col("a")) & is_object(F.col("b"))
        same = F.coalesce(number(F.col("a")) == number(F.col("b")), F.lit(False)) | F.to_json("a").eqNullSafe(F.to_json("b"))
        kind = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~deeper & ~same, "changed")
        out.append(level.select(F.col("k").alias(key), "path", kind.alias("kind"), shown(F.col("a")).alias("old"), shown(F.col("b")).alias("new")).where("kind IS NOT NULL"))
        pairs = level.where(deeper).select("k", "path", "a", "b")
        if pairs.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), out)
