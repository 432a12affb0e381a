"""Sinks: Parquet, appended JSON lines, wide CSV matrices and a small Markdown table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def matrix_csv(long: DataFrame, row: str, column: str, value: str, path: str) -> None:
    """A wide table of at most Spark's pivot limit of columns."""
    long.groupBy(row).pivot(column).agg({value: "max"}).orderBy(row).write.mode("overwrite").option("header", True).csv(path)


def markdown(frame: DataFrame, rows: int = 50) -> str:
    """The first rows as a padded table: a report for reading, bounded by `rows`."""
    head, body = frame.columns, [[str(v) for v in r] for r in frame.limit(rows).collect()]
    width = [max(len(x) for x in col) for col in zip(head, *body, strict=True)] if body else [len(h) for h in head]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, body)])


def report(frame: DataFrame, path: str, rows: int = 1000) -> None:
    """The first rows as one JSON document: a report for reading, bounded by `rows`."""
    packed = frame.limit(rows).agg(F.collect_list(F.struct(*frame.columns)).alias("rows"))
    packed.select(F.to_json(F.struct("rows")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def fresh(spark: SparkSession, path: str, make: Callable[[], DataFrame], stamp: str) -> DataFrame:
    """The table at `path` if it carries the stamp (a day, say), else what `make` gives, written there under it. Parquet and a folder name, so that any task can read it."""
    where = f"{path}/stamp={stamp}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(where)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
