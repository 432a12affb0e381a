"""Readers of the file shapes the engine ingests. All go through Spark's own sources, with stated schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAV_SCHEMA = "date string, data array<struct<date:string, nav:string>>"


def nav_json(spark: SparkSession, path: str) -> DataFrame:
    """NAV history files -> (file, date, nav): day-first dates, numbers as text, values of 0 and less dropped."""
    raw = spark.read.schema(NAV_SCHEMA).option("multiLine", True).json(path)
    rows = raw.select(F.input_file_name().alias("file"), F.explode("data").alias("d"))
    return rows.select("file", F.to_date("d.date", "dd-MM-yyyy").alias("date"), F.expr("try_cast(d.nav AS double)").alias("nav")).where("nav > 0")


def new_navs(landed: DataFrame, cached: DataFrame) -> DataFrame:
    """Landed rows after each scheme's last cached date."""
    last = cached.groupBy("scheme").agg(F.max("date").alias("last"))
    return landed.join(last, "scheme", "left").where(F.col("last").isNull() | (F.col("date") > F.col("last"))).drop("last")


def experiment_log(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON lines, malformed ones dropped, with the run's tag from the file name."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    return rows.withColumn("tag", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))


def padded_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose headers are padded and whose numbers have thousands commas."""
    raw = spark.read.option("header", True).csv(path)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in trimmed.columns])


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("double")


def subtitles(spark: SparkSession, path: str, from_second: int = 0) -> DataFrame:
    """SRT files -> (file, text) from a second on: tags stripped, repeated neighbours removed."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n\r?\n")).alias("n", "block"))
    at = [F.regexp_extract("block", r"(\d+):(\d+):(\d+)[,.]\d+ -->", k).try_cast("int") for k in (1, 2, 3)]
    rows = blocks.withColumn("second", at[0] * 3600 + at[1] * 60 + at[2]).withColumn("line", F.regexp_replace(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n", ""), r"<[^>]+>", ""), r"^\s+|\s+$", ""))
    w = Window.partitionBy("file").orderBy("n")
    rows = rows.where((F.col("second") >= from_second) & (F.col("line") != "")).withColumn("before", F.lag("line").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("line")))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("text"))


def preferred(sources: list[DataFrame], min_rows: int = 200) -> DataFrame:
    """(ticker, date, close) of the first source that has the ticker with enough rows."""
    rows = None
    for rank, s in enumerate(sources):
        s = s.select("ticker", "date", "close", F.lit(rank).alias("rank"))
        rows = s if rows is None else rows.unionByName(s)
    good = rows.groupBy("ticker", "rank").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).groupBy("ticker").agg(F.min("rank").alias("rank"))
    return rows.join(good, ["ticker", "rank"], "left_semi").drop("rank")


def month_of(text: Column) -> Column:
    """The first day of a month written like Jan-20."""
    return F.to_date(F.concat(F.lit("01-"), text), "dd-MMM-yy")


def settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of settings, rules or seeds as one row of nested columns."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def deduplicated_bars(bars: DataFrame) -> DataFrame:
    """Pages of bars (symbol, trade_date, ..., page) as one row a day, of the first page that has it, oldest first."""
    w = Window.partitionBy("symbol", "trade_date").orderBy("page")
    return bars.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").orderBy("symbol", "trade_date")


def latest_nav(navs: DataFrame, words: str) -> DataFrame:
    """The latest value of each scheme (code, name, date, nav) whose name has the words."""
    found = navs.where(F.contains(F.lower("name"), F.lit(words.lower())))
    return found.groupBy("code", "name").agg(F.max("date").alias("date"), F.max_by("nav", "date").alias("nav"))
