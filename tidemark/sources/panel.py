"""The price panel: one row per (ticker, date), aligned and numbered.

Long format throughout; a wide table is only ever a pivot at the edge. A panel
has a row per ticker and trading day, so windows by ticker hold some thousands
of rows each, however many fills were aggregated into them: the aggregation is
the step that meets the large table, and it combines partially before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_ticker() -> WindowSpec:
    """Rows of a ticker in order of days."""
    return Window.partitionBy("ticker").orderBy("t")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def four(x: Column) -> Column:
    """To four decimals, halves up in plain double arithmetic."""
    return F.floor(x * 10000 + 0.5) / 10000.0


def panel(spark: SparkSession, sf_dir: str, key: str = "p_type") -> DataFrame:
    """close: value per unit; volume, dvol: units and value; dividend: mean discount; t: 1-based number of the ticker's day. `key` is an expression over part.

    The panel is persisted (memory, then disk): a plan reads it many times, the
    fills once. Later queries of a session over the same files find it again.
    """
    fills = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    names = read(spark, sf_dir, "part").select("p_partkey", F.expr(key).alias("ticker"))
    days = (
        fills.join(names, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("ticker", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
            F.sum("l_quantity").alias("volume"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("percents"),
            F.count("*").alias("fills"),
        )
    )
    # money is summed as whole cents, so the order of a distributed sum can't change a close
    days = days.select("ticker", "date", four(F.col("cents") / 100.0 / F.col("volume")).alias("close"), "volume", (F.col("cents") / 100.0).alias("dvol"), four(F.col("percents") / 100.0 / F.col("fills")).alias("dividend"))
    return days.withColumn("t", F.row_number().over(Window.partitionBy("ticker").orderBy("date"))).persist()


def aligned(panel: DataFrame) -> DataFrame:
    """The panel on one calendar: a row for every ticker and every date from its first on, the close carried forward.

    t: 1-based number of the date in the union calendar, the same for all tickers;
    n: number of the ticker's last own day; traded: whether the date is one;
    volume, dvol and dividend are 0 where it is not. Prices of one t are of one date.
    """
    dates = panel.select("date").distinct()
    # one row a date before the one ordered window
    calendar = dates.withColumn("t", F.row_number().over(Window.orderBy("date")))
    starts = panel.groupBy("ticker").agg(F.min("date").alias("first"))
    grid = starts.join(calendar, F.col("date") >= F.col("first")).select("ticker", "date", "t")  # calendar x universe: the aligned panel itself
    own = panel.select("ticker", "date", "close", "volume", "dvol", "dividend", F.col("t").alias("n"))
    rows = grid.join(own, ["ticker", "date"], "left")
    last = Window.partitionBy("ticker").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("volume", "dvol", "dividend")]
    return rows.select("ticker", "date", "t", F.last("close", ignorenulls=True).over(last).alias("close"), *zero, F.last("n", ignorenulls=True).over(last).alias("n"), F.col("n").isNotNull().alias("traded"))


def _sums(key: str) -> str:
    return f"""WITH sums AS (
  SELECT {key} AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(l_quantity) AS volume,
    sum(CAST(round(l_discount * 100) AS BIGINT)) AS percents, count(*) AS fills
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), days AS (
  SELECT ticker, date, floor(CAST(cents AS DOUBLE) / 100.0 / volume * 10000 + 0.5) / 10000.0 AS close, volume, CAST(cents AS DOUBLE) / 100.0 AS dvol,
    floor(CAST(percents AS DOUBLE) / 100.0 / fills * 10000 + 0.5) / 10000.0 AS dividend FROM sums
)"""


_RETS = "rets AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY t) - 1 AS ret, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY t)) AS lret FROM panel)"

#: The same panel in SQL, for checks.
SQL = f"""{_sums("p_type")}, panel AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM days),
{_RETS}"""

#: The aligned panel of brands: `own` has the tickers' own days, numbered by n.
ALIGNED_SQL = f"""{_sums("p_brand")}, own AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM days),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM own)),
starts AS (SELECT ticker, min(date) AS first FROM own GROUP BY ticker),
panel AS (
  SELECT s.ticker, c.date, c.t, last_value(o.close IGNORE NULLS) OVER w AS close, coalesce(o.volume, 0) AS volume, coalesce(o.dvol, 0) AS dvol,
    coalesce(o.dividend, 0) AS dividend, last_value(o.n IGNORE NULLS) OVER w AS n, o.n IS NOT NULL AS traded
  FROM starts s JOIN cal c ON c.date >= s.first LEFT JOIN own o ON o.ticker = s.ticker AND o.date = c.date
  WINDOW w AS (PARTITION BY s.ticker ORDER BY c.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
{_RETS}"""
