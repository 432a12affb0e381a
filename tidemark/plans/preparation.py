"""Corporate actions, universes, features and positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import functions
from tidemark.operators import prep, signals, simulation
from tidemark.plans.registry import query, r6, universe, with_returns
from tidemark.sources.panel import by_ticker, panel, read

#: Bars whose identifier changes every 90 days, and known actions every 500.
BARS = "+bars AS (SELECT ticker, date, t, close, CASE WHEN t % 31 = 0 THEN NULL ELSE ticker || '-' || CAST(t // 90 AS VARCHAR) END AS isin FROM panel), known AS (SELECT ticker, date AS ex_date, 2.0 AS factor FROM panel WHERE t % 500 = 0)"
_SNAP = "(SELECT CASE WHEN abs(f - {0}) / f <= 0.2 THEN f ELSE {0} END FROM (SELECT unnest([1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 100.0]) AS f) ORDER BY abs(f - {0}), f LIMIT 1)"
ISIN = BARS + ", ic AS (SELECT * FROM (SELECT ticker, date AS ex_date, lag(isin) OVER w AS before, isin, lag(close) OVER w / close AS ratio FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE before IS NOT NULL AND isin IS NOT NULL AND before <> isin AND (ratio <= 0.7 OR ratio >= 1.4)), cand AS (SELECT i.ticker, i.ex_date, i.ratio, f.f, row_number() OVER (PARTITION BY i.ticker, i.ex_date ORDER BY abs(f.f - i.ratio), f.f) AS rn FROM ic i CROSS JOIN (SELECT unnest([1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 100.0]) AS f) f), inf AS (SELECT ticker, ex_date, CASE WHEN abs(f - ratio) <= 0.2 * f THEN f ELSE ratio END AS factor FROM cand WHERE rn = 1)"


def bars(spark, sf_dir) -> DataFrame:
    isin = F.when(F.col("t") % 31 == 0, None).otherwise(F.concat("ticker", F.lit("-"), F.floor(F.col("t") / 90).cast("string")))
    return panel(spark, sf_dir).select("ticker", "date", "t", "close", isin.alias("isin"))


def known(rows: DataFrame) -> DataFrame:
    return rows.where("t % 500 = 0").select("ticker", F.col("date").alias("ex_date"), F.lit(2.0).alias("factor"))


@query(ISIN + " SELECT ticker, ex_date, round(factor, 6) AS factor FROM inf")
def prep_identity_factors(spark, sf_dir):
    return prep.changed_identity(bars(spark, sf_dir)).select("ticker", "ex_date", r6("factor"))


@query(None)
def prep_standing_factors(spark, sf_dir):
    """Inferred factors that are near no known one and no earlier one that stands."""
    rows = bars(spark, sf_dir)
    return prep.not_near(prep.changed_identity(rows), known(rows)).select("ticker", "ex_date", r6("factor"))


_ADJ = BARS + ", adj AS (SELECT b.ticker, b.date, b.close / coalesce(exp((SELECT sum(ln(factor)) FROM known k WHERE k.ticker = b.ticker AND k.ex_date > b.date)), 1) AS adj_close FROM bars b), rs AS (SELECT * FROM (SELECT ticker, date AS ex_date, lag(adj_close) OVER w / adj_close AS ratio, CAST(date - lag(date) OVER w AS BIGINT) AS gap FROM adj WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE gap <= 7 AND (ratio <= 0.7 OR ratio >= 1.4)), cand AS (SELECT i.ticker, i.ex_date, i.ratio, f.f, row_number() OVER (PARTITION BY i.ticker, i.ex_date ORDER BY abs(f.f - i.ratio), f.f) AS rn FROM rs i CROSS JOIN (SELECT unnest([1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 100.0]) AS f) f)"


@query(_ADJ + " SELECT ticker, ex_date, round(CASE WHEN abs(f - ratio) <= 0.2 * f THEN f ELSE ratio END, 5) AS factor FROM cand WHERE rn = 1 AND abs(CASE WHEN abs(f - ratio) <= 0.2 * f THEN f ELSE ratio END - 1) >= 0.05")
def prep_residual_factors(spark, sf_dir):
    rows = bars(spark, sf_dir)
    return prep.residual_factors(prep.split_adjusted(rows, known(rows))).select("ticker", "ex_date", r6("factor", 5))


@query(None)
def prep_fully_adjusted(spark, sf_dir):
    """Closes after known, inferred and residual actions, as logarithms."""
    rows = bars(spark, sf_dir)
    return prep.fully_adjusted(rows, known(rows)).select("ticker", "date", r6(F.ln("adj_close")).alias("log_close"))


@query("@n AS (SELECT ticker, count(*) AS n FROM panel WHERE traded AND t >= 500 AND t <= 999 GROUP BY ticker) SELECT p.ticker, p.t FROM panel p JOIN n ON n.ticker = p.ticker WHERE traded AND p.t >= 500 AND p.t <= 999 AND n.n >= 0.5 * 500")
def prep_populated(spark, sf_dir):
    """Rows of tickers that trade on at least half of a window's days."""
    rows = universe(spark, sf_dir).where("traded")
    return prep.populated(rows, 500, 999, 0.5).select("ticker", "t")


@query("!WITH s AS (SELECT p_partkey AS scheme_code, p_name || CASE p_size % 4 WHEN 0 THEN ' Fund - Direct Plan - Growth' WHEN 1 THEN ' Direct Plan Gr' WHEN 2 THEN ' Regular Plan - Growth Direct' ELSE ' Direct Monthly IDCW Growth' END AS scheme_name FROM part), f AS (SELECT *, lower(scheme_name) AS l FROM s) SELECT scheme_code, scheme_name, substr(" + "replace(" * len(prep.DROPPED) + "scheme_name" + "".join(f", '{w}', '')" for w in prep.DROPPED) + f", 1, 45) AS name FROM f WHERE contains(l, 'direct') AND (contains(l, 'growth') OR ends_with(l, ' gr')) AND NOT regexp_matches(l, '{'|'.join(prep.EXCLUDED)}')")
def prep_master_filter(spark, sf_dir):
    """Scheme names made of part names: direct growth plans, without the excluded kinds, and their short names."""
    kind = F.col("p_size") % 4
    tail = F.when(kind == 0, " Fund - Direct Plan - Growth").when(kind == 1, " Direct Plan Gr").when(kind == 2, " Regular Plan - Growth Direct").otherwise(" Direct Monthly IDCW Growth")
    schemes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("scheme_code"), F.concat("p_name", tail).alias("scheme_name"))
    return prep.master_filter(schemes)


@query("!SELECT CAST(p_partkey AS VARCHAR) AS ticker FROM part WHERE p_partkey IN (3, 5) OR regexp_matches(lower(p_name), 'gold|cold')")
def prep_safe_havens(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("name"))
    return prep.safe_havens(names, ["3", "5"], ["gold", "cold"])


@query("@s AS (SELECT CASE WHEN ticker IN ('Brand#11', 'Brand#12', 'Brand#13') THEN ticker END AS k, date, close FROM panel) SELECT date, max(CASE WHEN k = 'Brand#11' THEN close END) AS a, max(CASE WHEN k = 'Brand#12' THEN close END) AS b, max(CASE WHEN k = 'Brand#13' THEN close END) AS c FROM s WHERE k IS NOT NULL GROUP BY date")
def join_folded(spark, sf_dir):
    """Three frames side by side on all of their dates."""
    rows = universe(spark, sf_dir)
    return prep.folded([rows.where(F.col("ticker") == t).select("date", F.col("close").alias(n)) for t, n in (("Brand#11", "a"), ("Brand#12", "b"), ("Brand#13", "c"))], "date")


@query("@d AS (SELECT DISTINCT date, t FROM panel), g AS (SELECT unnest([DATE '1996-07-06', DATE '1998-12-25', DATE '2000-02-29', DATE '1990-01-01']) AS target) SELECT target, max(date) AS date, max(t) AS t FROM g LEFT JOIN d ON d.date <= target GROUP BY target")
def join_as_of_calendar(spark, sf_dir):
    """The last calendar row at or before each target: a union timeline, not a range join."""
    days = universe(spark, sf_dir).select("date", "t").distinct()
    targets = spark.sql("SELECT explode(array(DATE'1996-07-06', DATE'1998-12-25', DATE'2000-02-29', DATE'1990-01-01')) AS target")
    both = days.select("date", "t", F.lit(0).alias("o"), F.lit(None).cast("date").alias("target")).unionByName(targets.select(F.col("target").alias("date"), F.lit(None).cast("int").alias("t"), F.lit(1).alias("o"), "target"))
    w = Window.orderBy("date", "o").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    found = F.last(F.when(F.col("o") == 0, F.struct("date", "t")), ignorenulls=True).over(w)
    return both.withColumn("f", found).where("o = 1").select("target", F.col("f.date").alias("date"), F.col("f.t").alias("t"))


# --- signals over text and features -----------------------------------------------------------------------------------
POSITIVE, NEGATIVE = ["the", "tion", "est"], ["ing", "les", "und"]
_HAS = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


@query(f"!SELECT doc_id, round(coalesce((p - n) * 0.7 / nullif(p + n, 0), 0), 6) AS score FROM (SELECT doc_id, {_HAS(POSITIVE)} AS p, {_HAS(NEGATIVE)} AS n FROM documents)")
def sig_presence_polarity(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", r6(signals.presence_polarity(F.col("text"), POSITIVE, NEGATIVE)).alias("score"))


@query("@b AS (SELECT date, avg(greatest(least(ret, 0.2), -0.2)) AS r, sum(CASE WHEN close / p20 - 1 > 0 THEN 1 ELSE 0 END) / greatest(count(p20), 1) AS breadth FROM (SELECT *, lag(close, 20) OVER (PARTITION BY ticker ORDER BY t) AS p20 FROM rets) GROUP BY date) SELECT date, round(breadth, 6) AS breadth FROM b")
def mom_breadth(spark, sf_dir):
    """The share of tickers that rose over 20 days, of one calendar."""
    rows = universe(spark, sf_dir).withColumn("m", F.try_divide(F.col("close"), F.lag("close", 20).over(by_ticker())) - 1)
    return rows.groupBy("date").agg(r6(F.sum(F.when(F.col("m") > 0, 1).otherwise(0)) / F.greatest(F.count("m"), F.lit(1))).alias("breadth"))


@query("@m AS (SELECT date, avg(greatest(least(ret, 0.2), -0.2)) AS r FROM rets GROUP BY date) SELECT date, round(ln(level), 6) AS log_level FROM (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS level FROM m)")
def sig_market_level(spark, sf_dir):
    return signals.market_level(universe(spark, sf_dir)).select("date", r6(F.ln("level")).alias("log_level"))


@query("@m AS (SELECT t, avg(close) AS p FROM panel GROUP BY t) SELECT t, CASE WHEN p / lag(p, 504) OVER (ORDER BY t) - 1 < 0 AND p / lag(p, 21) OVER (ORDER BY t) - 1 > 0.05 THEN 0.5 ELSE 1.0 END AS scale FROM m")
def sig_crash_protection(spark, sf_dir):
    m = universe(spark, sf_dir).groupBy("t").agg(F.avg("close").alias("p"))  # a row a date before the one ordered window
    w = Window.orderBy("t")
    fall, rise = F.col("p") / F.lag("p", 504).over(w) - 1 < 0, F.col("p") / F.lag("p", 21).over(w) - 1 > 0.05
    return m.select("t", F.when(fall & rise, 0.5).otherwise(1.0).alias("scale"))


FEATURES = ["close", "volume", "dvol", "dividend", "ret", "lret"]


@query("+SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END), 8) AS ratio FROM rets" for f in FEATURES) + ")")
def sig_null_ratios(spark, sf_dir):
    return signals.null_ratios(with_returns(spark, sf_dir), FEATURES).select("feature", r6("ratio", 8))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("+SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM rets WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS) + ") WHERE abs(r) > 0.7")
def sig_correlated_features(spark, sf_dir):
    """Pairs of features whose correlation is beyond 0.7 either way."""
    return signals.correlated_features(with_returns(spark, sf_dir), FEATURES, 0.7).select("a", "b", r6("r"))


@query("!WITH p AS (SELECT user_id, CAST(last_day(CAST(date_trunc('quarter', ts) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS q, avg(value) AS m FROM events GROUP BY 1, 2), g AS (SELECT q, avg(m) AS score, count(*) AS n FROM p GROUP BY q), d AS (SELECT CAST(unnest(generate_series((SELECT min(q) FROM g), DATE '2026-06-30', INTERVAL 1 DAY)) AS DATE) AS date) SELECT d.date, round(g.score, 6) AS score, g.n, CAST(isodow(d.date) < 6 AS BOOLEAN) AS business FROM d ASOF JOIN g ON d.date >= g.q")
def sig_quarter_daily(spark, sf_dir):
    """Quarter means by user carried to every day after the quarter's end, up to a fixed last day."""
    per = read(spark, sf_dir, "events").groupBy("user_id", functions.quarter_end(F.to_date("ts")).alias("q")).agg(F.avg("value").alias("m"))
    quarters = per.groupBy("q").agg(F.avg("m").alias("score"), F.count("*").alias("n"))
    return signals.daily_from_quarters(quarters, F.lit("2026-06-30").cast("date")).select("date", r6("score"), "n", "business")


@query("SELECT ticker, t, round(CASE WHEN abs(tstat) > 1.5 THEN slope * 252 ELSE 0 END, 6) AS signal FROM (SELECT ticker, t, regr_slope(ln(close), t) OVER y AS slope, CASE WHEN regr_count(ln(close), t) OVER y > 2 THEN regr_slope(ln(close), t) OVER y / nullif(sqrt(greatest(regr_syy(ln(close), t) OVER y - pow(regr_sxy(ln(close), t) OVER y, 2) / regr_sxx(ln(close), t) OVER y, 0) / (regr_count(ln(close), t) OVER y - 2)) / sqrt(regr_sxx(ln(close), t) OVER y), 0) END AS tstat FROM rets WINDOW y AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))")
def sig_trend_gate(spark, sf_dir):
    """The yearly slope where its t statistic is beyond 1.5, else 0."""
    slope, tstat = signals.trend_t()
    rows = with_returns(spark, sf_dir).select("ticker", "t", slope.alias("slope"), tstat.alias("tstat"))
    return rows.select("ticker", "t", r6(F.when(F.abs("tstat") > 1.5, F.col("slope") * 252).otherwise(0.0)).alias("signal"))


# --- positions --------------------------------------------------------------------------------------------------------
_POS = "@pos AS (SELECT c_custkey AS id, 'Brand#' || CAST(1 + c_nationkey % 5 AS VARCHAR) || CAST(1 + c_custkey % 5 AS VARCHAR) AS ticker, 1 + c_custkey % 40 AS shares, 1000.0 + c_acctbal / 20 AS cost FROM customer), lastp AS (SELECT ticker, arg_max(close, t) AS price FROM panel GROUP BY ticker)"


def positions(spark, sf_dir) -> DataFrame:
    """(id, ticker, shares, cost): positions made of customers."""
    ticker = F.concat(F.lit("Brand#"), (1 + F.col("c_nationkey") % 5).cast("string"), (1 + F.col("c_custkey") % 5).cast("string"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ticker.alias("ticker"), (1 + F.col("c_custkey") % 40).alias("shares"), (1000.0 + F.col("c_acctbal") / 20).alias("cost"))


@query(_POS + ", v AS (SELECT id, pos.ticker, shares * cost AS basis, shares * price AS value FROM pos JOIN lastp ON lastp.ticker = pos.ticker), t AS (SELECT id, ticker, basis, value FROM v UNION ALL SELECT NULL, 'TOTAL', sum(basis), sum(value) FROM v) SELECT id, ticker, round(basis, 4) AS basis, round(value, 4) AS value, round(value - basis, 4) AS pnl, round(value / basis - 1, 6) AS pct FROM t")
def pos_profit(spark, sf_dir):
    """Cost, value and gain of every position, and the total's row."""
    last = universe(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "t").alias("price"))
    v = positions(spark, sf_dir).join(last, "ticker").select("id", "ticker", (F.col("shares") * F.col("cost")).alias("basis"), (F.col("shares") * F.col("price")).alias("value"))
    rows = v.unionByName(v.agg(F.sum("basis").alias("basis"), F.sum("value").alias("value")).select(F.lit(None).cast("long").alias("id"), F.lit("TOTAL").alias("ticker"), "basis", "value"))
    return rows.select("id", "ticker", r6("basis", 4), r6("value", 4), r6(F.col("value") - F.col("basis"), 4).alias("pnl"), r6(F.col("value") / F.col("basis") - 1).alias("pct"))


@query(_POS + ", e AS (SELECT id, pos.ticker, cost, coalesce(min(CASE WHEN abs(close / cost - 1) <= 0.05 THEN p.t END), arg_min(p.t, (abs(close - cost), p.t))) AS entry FROM pos JOIN panel p ON p.ticker = pos.ticker GROUP BY 1, 2, 3), mk AS (SELECT t, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY t)) AS level FROM (SELECT t, avg(greatest(least(ret, 0.2), -0.2)) AS r FROM rets GROUP BY t)), en AS (SELECT max(t) AS t FROM panel) SELECT id, e.ticker, entry, round(price / cost - 1, 6) AS own, round(ln(z.level / a.level), 6) AS market FROM e JOIN lastp ON lastp.ticker = e.ticker JOIN mk a ON a.t = e.entry JOIN mk z ON z.t = (SELECT t FROM en)")
def pos_alpha(spark, sf_dir):
    """Each position's gain since the first day its ticker stood within 5 % of the cost (else nearest to it), and the market's growth since."""
    rows = universe(spark, sf_dir)
    calendar = rows.select("date", "t").distinct()
    level = signals.market_level(rows).join(calendar, "date").select("t", "level")
    last = rows.groupBy("ticker").agg(F.max_by("close", "t").alias("price"))
    entry = simulation.entry_days(positions(spark, sf_dir), rows)
    final = level.agg(F.max_by("level", "t").alias("end"))
    out = entry.join(last, "ticker").join(level.withColumnRenamed("t", "entry"), "entry").join(F.broadcast(final), how="cross")  # one row
    return out.select("id", "ticker", "entry", r6(F.col("price") / F.col("cost") - 1).alias("own"), r6(F.ln(F.col("end") / F.col("level"))).alias("market"))


@query("@x AS (SELECT ticker, t, close, lag(close, 21) OVER w AS m1, lag(close, 63) OVER w AS m3, max(t) OVER (PARTITION BY ticker) AS last, first_value(close) OVER w AS ref FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t)) SELECT ticker, CASE WHEN close / ref - 1 > 0.2 THEN 'above' WHEN close / ref - 1 < -0.2 THEN 'below' ELSE 'inside' END AS band, close / m1 - 1 > 0.1 AS surging, close / m1 - 1 < -0.1 AND close / m3 - 1 < 0 AS fading FROM x WHERE t = last")
def pos_alerts(spark, sf_dir):
    """A band of 20 % about the reference price, and momentum alerts, at the last day."""
    rows = universe(spark, sf_dir)
    w = by_ticker()
    rows = rows.select("ticker", "t", "close", F.lag("close", 21).over(w).alias("m1"), F.lag("close", 63).over(w).alias("m3"), F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ref"), F.max("t").over(Window.partitionBy("ticker")).alias("last")).where("t = last")
    gain, month, quarter = F.col("close") / F.col("ref") - 1, F.col("close") / F.col("m1") - 1, F.col("close") / F.col("m3") - 1
    return rows.select("ticker", F.when(gain > 0.2, "above").when(gain < -0.2, "below").otherwise("inside").alias("band"), (month > 0.1).alias("surging"), ((month < -0.1) & (quarter < 0)).alias("fading"))


@query("!SELECT o_orderkey, CAST(o_orderkey % 97 AS BIGINT) AS n_survivable, CAST(1 + o_orderkey % 997 AS BIGINT) AS n_combos, CAST(o_orderkey % 11 AS BIGINT) AS n_folds, round((o_orderkey % 1000) / 10.0 - 50, 1) AS median FROM orders")
def fn_log_metrics(spark, sf_dir):
    """Metrics read back from a printed log."""
    k = F.col("o_orderkey")
    log = F.concat(F.lit("\x1b[1mSurvivable (DD<=50%): "), (k % 97).cast("string"), F.lit("/"), (1 + k % 997).cast("string"), F.lit("\x1b[0m\ncombos=5 folds="), (k % 11).cast("string"), F.lit("\nOOS best: +1.5%  median: "), F.format_string("%+.1f", (k % 1000) / 10.0 - 50), F.lit("%\n"))
    return read(spark, sf_dir, "orders").select("o_orderkey", functions.log_metrics(log).alias("m")).select("o_orderkey", "m.n_survivable", "m.n_combos", "m.n_folds", "m.median")


@query("!SELECT c_custkey, c_mktsegment AS s_segment, CAST(c_nationkey AS VARCHAR) || ',' || CAST(c_custkey % 3 AS VARCHAR) AS s_lookbacks, c_acctbal AS bt_score FROM customer")
def fn_flattened(spark, sf_dir):
    """Nested records as flat columns, arrays as text."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 3).alias("lookbacks")).alias("strategy"), F.struct(F.col("c_acctbal").alias("score")).alias("backtest"))
    return rows.select("c_custkey", *functions.flattened("s", "strategy", ["segment", "lookbacks"], ("lookbacks",)), *functions.flattened("bt", "backtest", ["score"]))
