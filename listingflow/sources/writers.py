"""Writers of records, routes, registries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as lines of JSON; ``append`` adds those of one more page."""
    df.write.mode(mode).json(path)


def write_routes(df: DataFrame, path: str, route: str = "route") -> None:
    """Records in a folder for each route; a failed task leaves none behind."""
    df.write.mode("overwrite").partitionBy(route).json(path)


def write_registry(df: DataFrame, path: str, version: int) -> str:
    """A snapshot of the registry in a folder of its own version; readers take the last that is complete."""
    target = f"{path}/version={version:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """A report, in order, as text."""
    df.select(F.col(line).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_errors(df: DataFrame, path: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one, which are also written."""
    bad = df.where(F.col(error).isNotNull())
    bad.write.mode("append").json(path)
    return df.where(F.col(error).isNull()).drop(error), bad


def write_documents(df: DataFrame, path: str, folder: str, text: str) -> None:
    """Texts in a folder for each sanitised name."""
    df.select(F.regexp_replace(F.col(folder), "[^A-Za-z0-9]", "_").alias("folder"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("folder").text(path)
