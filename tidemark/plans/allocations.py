"""Allocation pipelines over scores, their constraints, and options, with SQL where rounds of dropping names aren't needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import functions
from tidemark.operators import allocation, scoring
from tidemark.operators import momentum as mom
from tidemark.plans.registry import query, r6, universe
from tidemark.plans.scoring import ASKED, LIVE, scores_at
from tidemark.sources.panel import read

CAPITAL = 100_000.0


@query("@" + ASKED + ", p AS (SELECT rt, ticker, round(greatest(1 / vol_factor, 0.5), 8) AS vol, score FROM f) SELECT ticker, rt, round(1 / vol / sum(1 / vol) OVER (PARTITION BY rt), 6) AS inv, round(sqrt(greatest(score, 1e-6)) / sum(sqrt(greatest(score, 1e-6))) OVER (PARTITION BY rt), 6) AS root, round(greatest(score, 1e-6) / sum(greatest(score, 1e-6)) OVER (PARTITION BY rt), 6) AS raw, round(1.0 / count(*) OVER (PARTITION BY rt), 6) AS even FROM p")
def alloc_weights(spark, sf_dir):
    rows = scores_at(spark, sf_dir).withColumn("vol", F.round(F.greatest(1 / F.col("vol_factor"), F.lit(0.5)), 8))
    keys = ["rt"]
    return rows.select("ticker", "rt", r6(allocation.inverse_vol(keys)).alias("inv"), r6(allocation.score_weight(keys, "sqrt_score")).alias("root"), r6(allocation.score_weight(keys, "score")).alias("raw"), r6(allocation.score_weight(keys, "equal")).alias("even"))


def offers(spark, sf_dir) -> DataFrame:
    return scores_at(spark, sf_dir).select("rt", "ticker", "score", F.round("wt_mom", 8).alias("wt_mom"), "adv60", "current_dd", "dv_slope", "smoothness", "ulcer_1y", "dist52", "latest_price")


_SIZED = "@" + ASKED + ", o AS (SELECT rt, ticker, score, round(wt_mom, 8) AS wt_mom, adv60, current_dd FROM f)"


@query(_SIZED + " SELECT rt, ticker, round(greatest(score, 0), 6) AS raw, round(sqrt(greatest(score, 0)), 6) AS root, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END AS even FROM o")
def alloc_sizing(spark, sf_dir):
    s = F.col("score")
    return offers(spark, sf_dir).select("rt", "ticker", r6(allocation.sized(s, "raw")).alias("raw"), r6(allocation.sized(s, "sqrt")).alias("root"), allocation.sized(s, "equal").alias("even"))


@query("!WITH RECURSIVE x AS (SELECT s_nationkey AS k, s_suppkey AS ticker, 1.0 + s_suppkey % 7 AS w, 10.0 + s_suppkey % 5 AS cap FROM supplier), o AS (SELECT k, ticker, w, cap, (cap - 0.01) / w AS fullness, row_number() OVER (PARTITION BY k ORDER BY (cap - 0.01) / w, ticker) AS i, sum(w) OVER (PARTITION BY k ORDER BY (cap - 0.01) / w, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM x), st AS (SELECT k, 0 AS i, CAST(0.0 AS DOUBLE) AS level, CAST(30.0 AS DOUBLE) AS rest FROM x GROUP BY k UNION ALL SELECT o.k, o.i, CASE WHEN rest > 0.01 AND level < fullness THEN level + least(rest, cap / w * open) / open ELSE level END, CASE WHEN rest > 0.01 AND level < fullness THEN rest - least(rest, cap / w * open) ELSE rest END FROM st JOIN o ON o.k = st.k AND o.i = st.i + 1), e AS (SELECT k, arg_max(level, i) AS level FROM st GROUP BY k) SELECT o.k, o.ticker, round(CASE WHEN level >= fullness THEN cap ELSE w * level END, 5) AS alloc FROM o JOIN e ON e.k = o.k")
def alloc_leaky_fill(spark, sf_dir):
    """The fill whose steps ignore what was poured before, as a fold over each group's names."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("ticker"), (1.0 + F.col("s_suppkey") % 7).alias("weight"), (10.0 + F.col("s_suppkey") % 5).alias("cap"))
    return allocation.leaky_fill(rows, ["k"], 30.0).select("k", "ticker", r6("alloc", 5))


@query(None)
def alloc_cascade(spark, sf_dir):
    rows = offers(spark, sf_dir)
    return allocation.cascade(rows, ["rt"], CAPITAL, 15, 0.15, 0.05, "sqrt").select("rt", "ticker", r6("alloc", 2))


@query(_SIZED + ", r AS (SELECT *, sum(score) OVER (PARTITION BY rt) AS total, row_number() OVER (PARTITION BY rt ORDER BY score DESC, ticker) AS rank FROM o WHERE wt_mom > 0), b AS (SELECT rt, ticker, total FROM r WHERE rank <= 15 AND score > 0) SELECT rt, ticker, round(least(100000.0 / count(*) OVER (PARTITION BY rt), 15000.0), 2) AS alloc FROM b")
def alloc_equal_parts(spark, sf_dir):
    """The cascade with equal sizes and no least part: every name gets the same, up to its cap."""
    return allocation.cascade(offers(spark, sf_dir), ["rt"], CAPITAL, 15, 0.15, 0.0, "equal").select("rt", "ticker", r6("alloc", 2))


def sleeves(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sleeve", F.substring("ticker", 7, 1))


@query(None)
def alloc_sleeves(spark, sf_dir):
    """No sleeve (the first digit of the brand) above its cap."""
    rows = sleeves(offers(spark, sf_dir)).select("rt", "ticker", "score", "wt_mom", "sleeve")
    out = allocation.sleeve_capped(rows, ["rt"], CAPITAL, 15, 0.15, 0.03, {"1": 0.40, "2": 0.30})
    return out.select("rt", "ticker", r6("alloc", 2))


def thesis(rows: DataFrame) -> DataFrame:
    """(ticker, group_id, max_picks): tickers of one last digit share a thesis, two picks each."""
    return rows.select("ticker").distinct().select("ticker", F.substring("ticker", -1, 1).alias("group_id"), F.lit(2).alias("max_picks"))


@query("@" + LIVE + ", o AS (SELECT ticker, round(score_sortino, 8) AS score, wt_mom, substr(ticker, -1, 1) AS g, round(score_sortino, 8) * (1 - (CASE WHEN substr(ticker, -2, 1) = '1' THEN 0.1 ELSE 0 END)) AS net FROM sc), k AS (SELECT ticker, row_number() OVER (PARTITION BY g ORDER BY net DESC, ticker) AS rn FROM o WHERE round(wt_mom, 8) > 0) SELECT ticker, round(score, 6) AS score FROM o WHERE ticker NOT IN (SELECT ticker FROM k WHERE rn > 2)")
def alloc_thesis(spark, sf_dir):
    """Two of each thesis by score net of fees; names without momentum neither compete nor go."""
    rows = live(spark, sf_dir)
    fees = rows.select("ticker", F.when(F.substring("ticker", -2, 1) == "1", 0.1).otherwise(0.0).alias("fee"))
    return allocation.group_limit(rows, thesis(rows), fees, "wt_mom").select("ticker", r6("score"))


def live(spark, sf_dir) -> DataFrame:
    """The scores of the last date."""
    days = universe(spark, sf_dir).agg(F.max("t").alias("t"))
    return scores_at(spark, sf_dir, days).withColumn("wt_mom", F.round("wt_mom", 8)).drop("rt")


@query(None)
def alloc_overlap(spark, sf_dir):
    """Allocated, then without what the chosen funds hold, then allocated anew: the five 'Brand#5' stand for funds that hold 'Brand#2' and, above a combined weight, 'Brand#3'."""
    rows = live(spark, sf_dir).withColumn("g", F.lit(1))
    first = allocation.cascade(rows, ["g"], CAPITAL, 15, 0.15, 0.03)
    funds = rows.where(F.col("ticker").startswith("Brand#5")).select(F.col("ticker").alias("fund"))
    named = rows.select("ticker").where(F.col("ticker").startswith("Brand#2") | F.col("ticker").startswith("Brand#3"))
    overlap = funds.crossJoin(named).withColumn("threshold", F.when(F.col("ticker").startswith("Brand#3"), 0.25).otherwise(0.0))  # a handful of funds
    holdings = overlap.select("fund", "ticker", F.lit(0.04).alias("weight"))
    again = allocation.cascade(allocation.without_overlap(first, rows, overlap, holdings), ["g"], CAPITAL, 15, 0.15, 0.03)
    return again.select("ticker", r6("alloc", 2))


@query(None)
def alloc_pipeline(spark, sf_dir):
    """Gates, thesis groups, rank scores, allocation and sleeves in a row, rounded to thousands, with the shares of the whole."""
    rows = live(spark, sf_dir).where("adv60 >= 0 AND current_dd >= -0.99")
    rows = scoring.rank_scores(allocation.group_limit(rows, thesis(rows), gate="wt_mom").withColumn("g", F.lit(1)), ["g"])
    out = allocation.sleeve_capped(sleeves(rows).select("g", "ticker", F.col("score_rank").alias("score"), "wt_mom", "sleeve"), ["g"], CAPITAL, 15, 0.15, 0.03, {"1": 0.40, "2": 0.30})
    return out.select("ticker", allocation.round_to(F.col("alloc")).alias("alloc"), r6(F.col("alloc") / F.sum("alloc").over(Window.partitionBy("g"))).alias("share"))


@query("!WITH RECURSIVE x AS (SELECT s_nationkey AS k, s_suppkey AS ticker, greatest(s_acctbal, 0) + 1 AS w FROM supplier), it AS (SELECT k, ticker, w / sum(w) OVER (PARTITION BY k) AS w, 0 AS i FROM x UNION ALL SELECT k, ticker, least(greatest(w, 0.05), 0.4) / sum(least(greatest(w, 0.05), 0.4)) OVER (PARTITION BY k), i + 1 FROM it WHERE i < 10) SELECT k, ticker, round(w, 6) AS w FROM it WHERE i = 10")
def alloc_clipped(spark, sf_dir):
    """Weights brought between 5 and 40 per cent, ten times over."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("ticker"), (F.greatest("s_acctbal", F.lit(0.0)) + 1).alias("weight"))
    rows = rows.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("k")))
    return allocation.clipped_weights(rows, ["k"], 0.05, 0.4).select("k", "ticker", r6("weight").alias("w"))


BUCKETS = [("core", 0.60, 0.80), ("max", 0.30, 0.95), ("safe", 0.10, 1.00)]
_CAP = " UNION ALL ".join(f"SELECT '{b}' AS bucket, {s * CAPITAL} AS capital, {d} AS lim" for b, s, d in BUCKETS)


@query("@" + LIVE + f", bk AS ({_CAP}), c AS (SELECT bucket, capital, ticker, latest_price AS price, row_number() OVER (PARTITION BY bucket ORDER BY round(score_sortino, 8) DESC, ticker) AS rank FROM sc, bk WHERE abs(max_dd_1y) <= lim AND round(score_sortino, 8) > 0), h AS (SELECT bucket, ticker, floor(capital / count(*) OVER (PARTITION BY bucket) / price) AS shares, price FROM c WHERE rank <= 4) SELECT ticker, CAST(sum(shares) AS BIGINT) AS shares, round(sum(shares * price), 4) AS spent, string_agg(bucket, ',' ORDER BY bucket) AS buckets FROM h GROUP BY ticker")
def alloc_buckets(spark, sf_dir):
    """Three buckets of capital by depth of the last year, four names each in whole shares, put together by ticker."""
    rows = live(spark, sf_dir).where("score > 0")
    options = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s * CAPITAL).alias("capital"), F.lit(d).alias("depth")) for b, s, d in BUCKETS])
    rows = rows.select("ticker", "score", "max_dd_1y", F.col("latest_price").alias("price"), F.explode(options).alias("b")).select("*", "b.*").where(F.abs("max_dd_1y") <= F.col("depth"))
    held = allocation.whole_shares(scoring.top(rows, ["bucket"], 4), ["bucket"], "capital")
    return allocation.combined_positions(held).select("ticker", "shares", r6("spent", 4), "buckets")


_N1 = "1 - exp(-d1 * d1 / 2) / 2.5066282746310002 * t1 * (0.319381530 + t1 * (-0.356563782 + t1 * (1.781477937 + t1 * (-1.821255978 + t1 * 1.330274429))))"
_N2 = _N1.replace("d1", "d2").replace("t1", "t2")


@query(f"!WITH x AS (SELECT p_partkey, p_retailprice AS s, floor(p_retailprice * 0.95 * 100 + 0.5) / 100 AS k, 90 / 365.0 AS y, 0.05 AS r, 0.2 + p_size / 200.0 AS v, p_size % 7 * 60 AS held FROM part), d AS (SELECT *, (ln(s / k) + (r + v * v / 2) * y) / (v * sqrt(y)) AS d1 FROM x), e AS (SELECT *, d1 - v * sqrt(y) AS d2 FROM d), n AS (SELECT *, 1 / (1 + 0.2316419 * abs(d1)) AS t1, 1 / (1 + 0.2316419 * abs(d2)) AS t2 FROM e), c AS (SELECT *, CASE WHEN d1 >= 0 THEN {_N1} ELSE 1 - ({_N1}) END AS n1, CASE WHEN d2 >= 0 THEN {_N2} ELSE 1 - ({_N2}) END AS n2 FROM n), p AS (SELECT *, floor((k * exp(-r * y) * (1 - n2) - s * (1 - n1)) * 100 + 0.5) / 100 AS premium FROM c) SELECT p_partkey, k AS strike, premium, CAST(least(greatest(1, held // 100), coalesce(floor(0.05 * s * held / nullif(premium * 100, 0)), 0)) AS BIGINT) AS contracts FROM p")
def alloc_put_overlay(spark, sf_dir):
    """Puts 5 % below each holding, as many as cover it and 5 % of its value pays for."""
    price, vol = F.col("p_retailprice"), 0.2 + F.col("p_size") / 200.0
    held = F.col("p_size") % 7 * 60
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", held.alias("held"), functions.option_record("put", price, vol, 0.05).alias("o"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("held") / 100))
    return rows.select("p_partkey", "o.strike", "o.premium", functions.affordable(wanted, F.col("o.premium"), 0.05 * price * F.col("held")).cast("long").alias("contracts"))


@query("@s AS (SELECT ticker, max(t) AS last FROM panel GROUP BY ticker), x AS (SELECT p.ticker, " + ", ".join(f"max(CASE WHEN t = last - {k} THEN close END) AS p{k}" for k in (9, 20, 59, 125, 251)) + " FROM panel p JOIN s ON s.ticker = p.ticker GROUP BY p.ticker), d AS (SELECT ticker, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS dvol FROM rets GROUP BY ticker) SELECT x.ticker, round(p20 / p251 - 1, 6) AS m12_1, round(p20 / p125 - 1, 6) AS m6_1, round(p9 / p59 - 1, 6) AS w12_2, round((p20 / p251 + p20 / p125 + p9 / p59 - 3) / 3 / dvol, 6) AS score FROM x JOIN d ON d.ticker = x.ticker")
def mom_three_averages(spark, sf_dir):
    """12-1, 6-1 and 12w-2w momentum from the last rows, and their mean over downside volatility."""
    rows = universe(spark, sf_dir)
    at = lambda k: mom.back("close", k)
    made = rows.select("ticker", "t", "ret", (at(20) / at(251) - 1).alias("m12_1"), (at(20) / at(125) - 1).alias("m6_1"), (at(9) / at(59) - 1).alias("w12_2"))
    g = made.groupBy("ticker").agg(F.max_by(F.struct("m12_1", "m6_1", "w12_2"), "t").alias("m"), (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(252.0))).alias("dvol"))
    return g.select("ticker", *[r6(F.col(f"m.{c}")).alias(c) for c in ("m12_1", "m6_1", "w12_2")], r6((F.col("m.m12_1") + F.col("m.m6_1") + F.col("m.w12_2")) / 3 / F.col("dvol")).alias("score"))
