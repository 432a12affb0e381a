"""Fund rotation rules, taxed switches and what a switch needs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import funds, prep
from tidemark.plans.registry import query, r6
from tidemark.sources.panel import panel

GROUPS = {"a": ["ECONOMY", "LARGE"], "b": ["MEDIUM", "PROMO"], "c": ["SMALL", "STANDARD"]}
CAPITAL, LIQUID_YIELD = 1_000_000.0, 0.06
RULES = ["hold", "april", "harvest", "dual", "semi", "group", "quarter"]


def months(spark, sf_dir) -> DataFrame:
    rows = funds.with_momentum(prep.resample(panel(spark, sf_dir)))
    return rows.withColumn("mom", F.round("mom", 8)).withColumn("year", F.round("year", 8))


def targets(spark, sf_dir) -> DataFrame:
    """(rule, i, period, fund) of every rule: the registry of target selections."""
    rows = months(spark, sf_dir)
    pairs = [F.struct(F.lit(t).alias("ticker"), F.lit(g).alias("group_id")) for g, names in GROUPS.items() for t in names]
    groups = spark.range(1).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    made = {
        "hold": funds.buy_and_hold(rows, "ECONOMY"),
        "april": funds.best_of(rows, [4]),
        "harvest": funds.harvested(rows),
        "dual": funds.best_of(rows, [4], or_cash=True),
        "semi": funds.best_of(rows, [4, 10]),
        "group": funds.best_group(rows, groups, [4]),
        "quarter": funds.best_of(rows, [1, 4, 7, 10], or_cash=True),
    }
    out = None
    for rule, frame in made.items():  # seven fixed rules
        frame = frame.select(F.lit(rule).alias("rule"), "i", "period", "fund")
        out = frame if out is None else out.unionByName(frame)
    return out


MONTHS = "+mo AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS close FROM panel GROUP BY 1, 2), cal AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i FROM (SELECT DISTINCT period FROM mo)), mm AS (SELECT mo.*, cal.i, round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1, 8) AS mom, round(close / lag(close, 12) OVER w - 1, 8) AS year FROM mo JOIN cal ON cal.period = mo.period WINDOW w AS (PARTITION BY ticker ORDER BY mo.period))"
BEST = ", bst AS (SELECT i, period, max(mom) AS mom, arg_max(ticker, (mom, ticker)) AS ticker FROM mm WHERE mom IS NOT NULL AND i >= 12 GROUP BY 1, 2)"
_GRP = " UNION ALL ".join(f"SELECT '{t}' AS ticker, '{g}' AS group_id" for g, names in GROUPS.items() for t in names)
BEST += f", gm AS ({_GRP}), gi AS (SELECT i, period, group_id, avg(mom) AS mean, max(mom) AS mom, arg_max(mm.ticker, (mom, mm.ticker)) AS ticker FROM mm JOIN gm ON gm.ticker = mm.ticker WHERE mom IS NOT NULL AND i >= 12 GROUP BY 1, 2, 3), gb AS (SELECT i, period, arg_max(mom, (mean, group_id)) AS mom, arg_max(ticker, (mean, group_id)) AS ticker FROM gi GROUP BY 1, 2)"


def _kept(rule: str, source: str, months_in: str, cash: bool) -> str:
    pick = "CASE WHEN mom < 0 THEN 'LIQUID' ELSE ticker END" if cash else "ticker"
    return f"SELECT '{rule}' AS rule, i, period, last_value(CASE WHEN month(period) IN ({months_in}) OR i = 12 THEN {pick} END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fund FROM {source}"


_RULES = {
    "hold": "SELECT DISTINCT 'hold' AS rule, i, period, 'ECONOMY' AS fund FROM mm WHERE i >= 12",
    "april": _kept("april", "bst", "4", False),
    "dual": _kept("dual", "bst", "4", True),
    "semi": _kept("semi", "bst", "4, 10", False),
    "group": _kept("group", "gb", "4", True),
    "quarter": _kept("quarter", "bst", "1, 4, 7, 10", True),
}
_HARVEST = ", hv AS (SELECT i, period, ticker AS fund FROM bst WHERE i = 12 UNION ALL SELECT b.i, b.period, CASE WHEN month(b.period) = 4 THEN b.ticker WHEN month(b.period) = 3 AND coalesce(y.year < 0, false) THEN 'LIQUID' ELSE hv.fund END FROM hv JOIN bst b ON b.i = hv.i + 1 LEFT JOIN mm y ON y.i = b.i AND y.ticker = hv.fund)"
TARGETS = MONTHS + BEST + _HARVEST + ", tg AS (" + " UNION ALL ".join(_RULES.values()) + " UNION ALL SELECT 'harvest', i, period, fund FROM hv)"


def _recursive(sql: str) -> str:
    """The same text with a recursive WITH."""
    return sql.replace("WITH sums", "WITH RECURSIVE sums", 1)


@query(TARGETS + " SELECT rule, period, fund FROM tg")
def sim_rotation(spark, sf_dir):
    """The fund that each of seven rules holds each month."""
    return targets(spark, sf_dir).select("rule", "period", "fund")


def fund_spells(spark, sf_dir) -> DataFrame:
    rows = months(spark, sf_dir)
    prices = rows.select("i", F.col("ticker").alias("fund"), "close")
    liquid = rows.select("i").distinct().select("i", F.lit(funds.CASH).alias("fund"), F.pow(F.lit(1 + LIQUID_YIELD), F.col("i") / 12.0).alias("close"))
    return funds.spells(targets(spark, sf_dir), prices.unionByName(liquid), ["rule"])


SPELLS = TARGETS + f", fl AS (SELECT rule, i, fund, sum(CASE WHEN fund <> coalesce(p, '') THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY i) AS spell FROM (SELECT *, lag(fund) OVER (PARTITION BY rule ORDER BY i) AS p FROM tg)), en AS (SELECT rule, spell, min(i) AS since, max(i) AS last, max(fund) AS fund FROM fl GROUP BY 1, 2), nx AS (SELECT *, lead(since) OVER (PARTITION BY rule ORDER BY spell) AS nxt FROM en), pr AS (SELECT i, ticker AS fund, close FROM mm UNION ALL SELECT DISTINCT i, 'LIQUID', pow({1 + LIQUID_YIELD}, i / 12.0) FROM mm), sp AS (SELECT n.rule, n.spell, n.fund, a.close AS entry, b.close AS exit, coalesce(nxt, last) - since AS months, nxt IS NULL AS open FROM nx n JOIN pr a ON a.fund = n.fund AND a.i = n.since JOIN pr b ON b.fund = n.fund AND b.i = coalesce(nxt, last)), tx AS (SELECT rule, CAST(0 AS BIGINT) AS spell, CAST({CAPITAL} AS DOUBLE) AS money, CAST(0 AS DOUBLE) AS tax, CAST(0 AS BIGINT) AS switches FROM sp WHERE spell = 1 UNION ALL SELECT s.rule, CAST(s.spell AS BIGINT), money * exit / entry - CASE WHEN open OR money * exit / entry <= money THEN 0 WHEN months >= 12 THEN 0.125 * greatest(money * exit / entry - money - 125000, 0) ELSE 0.2 * (money * exit / entry - money) END, tax + CASE WHEN open OR money * exit / entry <= money THEN 0 WHEN months >= 12 THEN 0.125 * greatest(money * exit / entry - money - 125000, 0) ELSE 0.2 * (money * exit / entry - money) END, switches + CASE WHEN open THEN 0 ELSE 1 END FROM tx JOIN sp s ON s.rule = tx.rule AND s.spell = tx.spell + 1)"


@query(SPELLS + " SELECT rule, spell, fund, entry, round(exit, 6) AS exit, months, open FROM sp")
def sim_fund_spells(spark, sf_dir):
    return fund_spells(spark, sf_dir).select("rule", "spell", "fund", r6("entry"), r6("exit"), "months", "open")


@query(SPELLS + " SELECT rule, round(ln(arg_max(money, spell)), 6) AS log_value, round(arg_max(tax, spell) / arg_max(money, spell), 6) AS tax_share, arg_max(switches, spell) AS switches FROM tx GROUP BY rule")
def sim_fund_rotation(spark, sf_dir):
    """What each rule's money comes to after tax."""
    out = funds.taxed(fund_spells(spark, sf_dir), ["rule"], CAPITAL)
    return out.select("rule", r6(F.ln("value")).alias("log_value"), r6(F.col("tax") / F.col("value")).alias("tax_share"), F.col("switches").cast("long").alias("switches"))


from tidemark.plans.registry import ORACLE_SQL  # noqa: E402

for _name in ("sim_rotation", "sim_fund_spells", "sim_fund_rotation"):
    ORACLE_SQL[_name] = _recursive(ORACLE_SQL[_name])
