"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.monitoring import latest_state


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_case(df: DataFrame, path: str, case_col: str = "case_id") -> None:
    """A folder per case, and a record of each case: its rows and when it was written."""
    df.write.mode("overwrite").partitionBy(case_col).parquet(f"{path}/rows")
    df.groupBy(case_col).agg(F.count("*").alias("rows"), F.current_timestamp().alias("written_at")).write.mode("overwrite").partitionBy(case_col).json(f"{path}/metadata")


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """A folder per sheet."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def pipe_lines(df: DataFrame, sheet: str) -> DataFrame:
    """The rows as lines with ``|`` between cells; null cells are empty."""
    return df.select(F.lit(sheet).alias("sheet"), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), "|").alias("line"))


def upsert(current: DataFrame, updates: DataFrame, key: str, at: str) -> DataFrame:
    """The state after updates: per key the row with the latest ``at``."""
    return latest_state(current.unionByName(updates, allowMissingColumns=True), key, [at])
