"""Where plans register queries, with their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import momentum as mom
from tidemark.sources.panel import ALIGNED_SQL, SQL, aligned, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a query. Its SQL stands alone after '!', continues the common tables of the panel after '+' and those of the aligned panel after '@', and selects from the panel's else."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            text = sql.strip()
            head, rest = text[0], text[1:].strip()
            if head == "!":
                ORACLE_SQL[name or f.__name__] = rest
            elif head in "+@":
                ORACLE_SQL[name or f.__name__] = f"{SQL if head == '+' else ALIGNED_SQL}{' ' if rest[:7].upper() == 'SELECT ' else ', '}{rest}"
            else:
                ORACLE_SQL[name or f.__name__] = f"{SQL} {text}"
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c), digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def sql6(c: Column | str, digits: int = 6) -> Column:
    """Rounded as the SQL's round() does, by a double's product with a power of ten: what is rounded twice often stands on a half, where the decimal digits of F.round say otherwise."""
    by = F.lit(10.0**digits)
    x = F.col(c) if isinstance(c, str) else c
    out = F.round(x * by) / by
    return out.alias(c) if isinstance(c, str) else out


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumn("ret", mom.simple_return()).withColumn("lret", mom.log_return())


def kept(frame: DataFrame) -> DataFrame:
    """`frame`, written once to the folder of spark.checkpoint.dir (a new temporary one in local mode, if unset): its plan is a scan from then on.

    A persisted frame still carries its whole plan, which every plan that reads it holds, and prints, once a reading:
    of frames that are persisted over each other the driver's copies grow as a product.
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return frame.checkpoint()


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned panel of brands, with returns from day to day; persisted like the panel."""
    return aligned(panel(spark, sf_dir, "p_brand")).withColumn("ret", mom.simple_return()).withColumn("lret", mom.log_return()).persist()


def lag(k: int) -> str:
    return f"lag(close, {k}) OVER w" if k else "close"


def fr(lo: int, hi: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {side(lo)} AND {side(hi)})"


ROOT = "sqrt(252)"
YEAR = fr(-251, 0)
NEG, CLIP = "CASE WHEN ret < 0 THEN ret END", "CASE WHEN ret IS NULL THEN 0 ELSE least(ret, 0) END"
