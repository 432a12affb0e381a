"""Queries of preparation, momentum, signals, risk, aggregates and joins, with their SQL; further plans are imported at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions, streaming
from tidemark.operators import allocation, prep, risk, signals, simulation, sweep
from tidemark.operators import momentum as mom
from tidemark.plans.registry import CLIP, NEG, ORACLE_SQL, QUERIES, ROOT, YEAR, fr, lag, query, r6, with_returns
from tidemark.sources.panel import SQL, by_ticker, panel, read


def column_query(name: str, columns: Callable[[], dict[str, Column | Callable[[], Column]]], sql: dict[str, str], digits: int = 6) -> None:
    """A query of new columns at every row of every ticker."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, made = with_returns(spark, sf_dir), columns()
        for c, e in made.items():
            rows = rows.withColumn(c, e() if callable(e) else e)
        kinds = dict(rows.dtypes)
        return rows.select("ticker", "t", *[r6(c, digits) if kinds[c] == "double" else F.col(c) for c in made])

    inner = ", ".join(f"{e} AS {c}" for c, e in sql.items())
    out = ", ".join(f"round({c}, {digits}) AS {c}" if not sql[c].startswith("/*raw*/") else c for c in sql)
    QUERIES[name] = run
    ORACLE_SQL[name] = f"{SQL} SELECT ticker, t, {out} FROM (SELECT ticker, t, {inner} FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY t))"


short = lambda lb, skip=21: f"coalesce({lag(skip)} / {lag(skip + lb - 1)} - 1, 0)"
full = lambda lb, skip=21: f"{lag(skip)} / {lag(skip + lb)} - 1"
prev = lambda lb, skip=21: f"{lag(skip + 1)} / {lag(skip + lb)} - 1"
BLEND = f"(0.2 * {short(63)} + 0.4 * {short(126)} + 0.4 * {short(252)})"

# --- momentum ---------------------------------------------------------------------------------------------------------
column_query("mom_returns", lambda: {"ret1": mom.simple_return(), "lret1": mom.log_return()}, {"ret1": "ret", "lret1": "lret"})
column_query("mom_skip_short", lambda: {f"m{lb}": mom.skip_short(lb) for lb in (21, 63, 126, 252)}, {f"m{lb}": short(lb) for lb in (21, 63, 126, 252)})
column_query("mom_skip_full", lambda: {f"m{lb}": mom.skip_full(lb) for lb in (63, 126, 252)}, {f"m{lb}": full(lb) for lb in (63, 126, 252)})
column_query("mom_no_skip", lambda: {"m63": mom.no_skip(63)}, {"m63": f"close / {lag(63)} - 1"})
column_query("mom_previous_bar", lambda: {f"m{lb}": mom.previous_bar(lb) for lb in (63, 126)}, {f"m{lb}": prev(lb) for lb in (63, 126)})
column_query("mom_blend", lambda: {"blend": mom.blend()}, {"blend": BLEND})
column_query(
    "mom_available_blend",
    lambda: {"blend": mom.available_blend()},
    {"blend": "(" + " + ".join(f"coalesce({w} * ({prev(lb)}), 0)" for lb, w in ((63, 0.2), (126, 0.4), (252, 0.4))) + ") / nullif(" + " + ".join(f"(CASE WHEN {lag(21 + lb)} IS NULL THEN 0 ELSE {w} END)" for lb, w in ((63, 0.2), (126, 0.4), (252, 0.4))) + ", 0)"},
)
column_query("mom_sign_composite", lambda: {"score": mom.sign_composite()}, {"score": f"abs(sign({short(63)}) + sign({short(126)}) + sign({short(252)})) / 3 * {BLEND}"})
column_query("mom_log", lambda: {"m": mom.log_momentum(126)}, {"m": f"ln({lag(21)} / {lag(146)})"})
column_query("mom_log_volnorm", lambda: {"m": mom.volnorm_log_momentum()}, {"m": f"ln({lag(21)} / {lag(146)}) / nullif(stddev_pop(lret) {fr(-145, -21)} * sqrt(126), 0)"})
column_query("mom_log_accel", lambda: {"m": mom.acceleration()}, {"m": f"ln({lag(21)} / {lag(146)}) + 0.5 * (ln({lag(21)} / {lag(83)}) - ln({lag(83)} / {lag(146)}))"})
column_query("mom_log_ewma", lambda: {"m": mom.ewma_log_momentum()}, {"m": f"sum(lret * exp(ln(2) / 63 * (t - 2000))) {fr(-145, -21)} / sum(CASE WHEN lret IS NOT NULL THEN exp(ln(2) / 63 * (t - 2000)) END) {fr(-145, -21)}"})
column_query("mom_weeks", lambda: {"flat": mom.weeks(), "tilted": mom.weeks(True)}, {k: " + ".join(f"{a} * (close / {lag(lb)} - 1)" for a, lb in zip(w, (5, 10, 20, 40), strict=True)) for k, w in (("flat", (0.25,) * 4), ("tilted", (0.4, 0.3, 0.2, 0.1)))})
column_query("mom_rolling_cagr", lambda: {f"y{y}": mom.rolling_cagr(y) for y in (1, 3, 5)}, {f"y{y}": f"pow(close / {lag(252 * y)}, 1.0 / {y}) - 1" for y in (1, 3, 5)})
column_query("mom_dual", lambda: {"absolute": mom.no_skip(252)}, {"absolute": f"close / {lag(252)} - 1"})
column_query("mom_pct_change", lambda: {"pct": F.round(mom.no_skip(10) * 100, 2)}, {"pct": f"round((close / {lag(10)} - 1) * 100, 2)"})


@query("SELECT ticker, t, round(list_sum(list_sort(l)[k + 1:n - k]), 6) AS m FROM (SELECT ticker, t, l, len(l) AS n, greatest(CAST(floor(len(l) * 0.05) AS INTEGER), 1) AS k FROM (SELECT ticker, t, list(lret) FILTER (lret IS NOT NULL) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 145 PRECEDING AND 21 PRECEDING) AS l FROM rets))")
def mom_log_trimmed(spark, sf_dir):
    return with_returns(spark, sf_dir).withColumn("m", mom.trimmed_log_momentum()).select("ticker", "t", r6("m"))


EPS = "+eps AS (SELECT ticker, date_trunc('quarter', date) AS q, CAST(date_trunc('quarter', date) AS DATE) AS report_date, round(avg(close), 4) AS eps FROM panel GROUP BY 1, 2), yoy AS (SELECT ticker, report_date, CASE WHEN p IS NULL THEN NULL WHEN abs(p) > 0.01 THEN (eps - p) / abs(p) ELSE sign(eps - p) END AS yoy FROM (SELECT *, lag(eps, 4) OVER (PARTITION BY ticker ORDER BY report_date) AS p FROM eps))"


def quarterly(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("ticker", F.to_date(F.date_trunc("quarter", "date")).alias("report_date")).agg(F.round(F.avg("close"), 4).alias("eps"))


@query(EPS + " SELECT ticker, report_date, round(yoy, 6) AS yoy FROM yoy")
def mom_earnings_yoy(spark, sf_dir):
    return mom.yoy_growth(quarterly(spark, sf_dir)).select("ticker", "report_date", r6("yoy"))


@query(EPS + " SELECT p.ticker, p.date, round(y.yoy, 6) AS yoy FROM panel p ASOF LEFT JOIN (SELECT * FROM yoy WHERE yoy IS NOT NULL) y ON p.ticker = y.ticker AND p.date >= y.report_date")
def join_as_of_earnings(spark, sf_dir):
    facts = mom.yoy_growth(quarterly(spark, sf_dir)).select("ticker", F.col("report_date").alias("date"), "yoy")
    return prep.as_of(panel(spark, sf_dir), facts, "ticker", "date", "yoy").select("ticker", "date", r6("yoy"))


@query("+m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS close FROM panel GROUP BY 1, 2) SELECT ticker, period, round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1, 6) AS mom FROM m WINDOW w AS (PARTITION BY ticker ORDER BY period)")
def mom_monthly_12_1(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("period")
    return prep.resample(panel(spark, sf_dir)).select("ticker", "period", r6(F.lag("close", 1).over(w) / F.lag("close", 12).over(w) - 1).alias("mom"))


# --- signals ----------------------------------------------------------------------------------------------------------
R2 = f"(CASE WHEN regr_syy(ln(close), t) {YEAR} > 0 THEN regr_r2(ln(close), t) {YEAR} ELSE 0 END)"
UP = f"avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) {YEAR}"
column_query("sig_trend_quality", lambda: {"r2": signals.trend_r2(), "fip": signals.share_up(), "smooth": signals.smoothness()}, {"r2": R2, "fip": UP, "smooth": f"sqrt({R2} * {UP})"})
DNV = {
    "dnv_hist_neg": f"coalesce(stddev_pop({NEG}) OVER w * {ROOT}, 1e-4)",
    "dnv_252_neg": f"greatest(coalesce(stddev_pop({NEG}) {YEAR} * {ROOT}, 1e-4), 1e-4)",
    "dnv_40_neg": f"coalesce(stddev_pop({NEG}) {fr(-39, 0)} * {ROOT}, 1e-4)",
    "dnv_252_clip0": f"stddev_pop({CLIP}) {YEAR} * {ROOT}",
    "dnv_252_rms0": f"sqrt(avg(({CLIP}) * ({CLIP})) {YEAR}) * {ROOT}",
    "dnv_panel_neg": f"stddev_pop({NEG}) {fr(-272, -21)} * {ROOT}",
    "dnv_window_neg": f"stddev_pop({NEG}) {fr(-272, 0)} * {ROOT}",
    "dnv_rms_neg": f"sqrt(avg(({NEG}) * ({NEG})) {YEAR}) * {ROOT}",
    "dnv_neg_ddof1": f"stddev_samp({NEG}) {YEAR} * {ROOT}",
    "dnv_monthly_sq": f"sqrt(avg(({CLIP}) * ({CLIP})) {fr(-11, 0)})",
}
column_query("sig_downside_vols", lambda: {k: (lambda k=k: signals.downside(k)) for k in signals.DOWNSIDE}, DNV)
R40 = f"CASE WHEN regr_syy(ln(close), t) {fr(-39, 0)} > 0 THEN regr_r2(ln(close), t) {fr(-39, 0)} ELSE 0 END"
TILT = " + ".join(f"{a} * (close / {lag(lb)} - 1)" for a, lb in zip((0.4, 0.3, 0.2, 0.1), (5, 10, 20, 40), strict=True))
column_query("mom_week_scores", lambda: {**{f"score_{k}w": mom.no_skip(5 * k) for k in (1, 2, 4, 8)}, "score_sortino": mom.weeks(True) * signals.smoothness(40) / signals.downside("dnv_40_neg")}, {**{f"score_{k}w": f"close / {lag(5 * k)} - 1" for k in (1, 2, 4, 8)}, "score_sortino": f"({TILT}) * sqrt({R40} * avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) {fr(-39, 0)}) / coalesce(stddev_pop({NEG}) {fr(-39, 0)} * {ROOT}, 1e-4)"}, digits=5)
column_query("sig_total_vol", lambda: {"vol": signals.total_vol()}, {"vol": f"greatest(coalesce(stddev_pop(ret) {fr(-125, 0)} * {ROOT}, 1e-4), 1e-4)"})
column_query("sig_trend_slope", lambda: {"slope": signals.trend_t()[0], "tstat": signals.trend_t()[1]}, {"slope": f"regr_slope(ln(close), t) {YEAR}", "tstat": f"CASE WHEN regr_count(ln(close), t) {YEAR} > 2 THEN regr_slope(ln(close), t) {YEAR} / nullif(sqrt(greatest(regr_syy(ln(close), t) {YEAR} - pow(regr_sxy(ln(close), t) {YEAR}, 2) / regr_sxx(ln(close), t) {YEAR}, 0) / (regr_count(ln(close), t) {YEAR} - 2)) / sqrt(regr_sxx(ln(close), t) {YEAR}), 0) END"})
column_query("sig_consistency", lambda: {"ok": signals.consistent()}, {"ok": "/*raw*/CASE WHEN lag(close, 272) OVER w IS NULL THEN true ELSE " + " + ".join(f"(CASE WHEN {lag(20 + 21 * k)} > {lag(41 + 21 * k)} THEN 1 ELSE 0 END)" for k in range(1, 12)) + " >= 8 END"})
HIGH = f"(1 - close / max(close) {YEAR})"
column_query("sig_high_distance", lambda: {"below": signals.below_high(), "factor": signals.level_factor(signals.below_high())}, {"below": HIGH, "factor": f"CASE WHEN {HIGH} < 0.10 THEN 1.10 WHEN {HIGH} < 0.25 THEN 1.0 ELSE greatest(0.85, 1.0 - 0.5 * ({HIGH} - 0.25)) END"})
TWO = f"regr_count(ln(greatest(dvol, 1e-4)), t) {fr(-62, 0)} > 1"
VS = f"(regr_slope(ln(greatest(dvol, 1e-4)), t) {fr(-62, 0)} * 252)"
column_query("sig_volume", lambda: {"slope": signals.volume_slope(), "factor": signals.volume_factor(signals.volume_slope()), "adv60": F.avg("dvol").over(mom.frame(-59, 0))}, {"slope": f"CASE WHEN {TWO} THEN {VS} END", "factor": f"CASE WHEN {TWO} THEN least(greatest(1 + 0.15 * {VS}, 0.7), 1.3) END", "adv60": f"avg(dvol) {fr(-59, 0)}"}, 7)
column_query("sig_rolling_max", lambda: {"peak": F.max("close").over(mom.frame(-62, 0))}, {"peak": f"max(close) {fr(-62, 0)}"})
column_query("sig_ma_cross", lambda: {"above": signals.ma_cross()}, {"above": f"/*raw*/CASE WHEN count(close) {fr(-199, 0)} = 200 THEN avg(close) {fr(-49, 0)} > avg(close) {fr(-199, 0)} END"})
column_query("sig_below_mean", lambda: {"below": signals.below_own_mean()}, {"below": f"/*raw*/lag(close) OVER w < avg(close) {fr(-100, -1)}"})
column_query("sig_vol_state", lambda: {"state": signals.vol_state()}, {"state": f"/*raw*/CASE WHEN stddev_pop(ret) {fr(-59, 0)} * {ROOT} < 0.14 THEN 'low' WHEN stddev_pop(ret) {fr(-59, 0)} * {ROOT} < 0.22 THEN 'mid' WHEN stddev_pop(ret) {fr(-59, 0)} IS NOT NULL THEN 'high' END"})
column_query("sig_zscore", lambda: {"z": signals.zscore("volume")}, {"z": f"coalesce(CASE WHEN count(volume) {YEAR} >= 5 THEN (volume - avg(volume) {YEAR}) / nullif(stddev_pop(volume) {YEAR}, 0) END, 0)"})
column_query("sig_rolling_sums", lambda: {"s21": signals.full_sum("volume", 21), "s60": signals.full_sum("volume", 60), "vlog": F.ln(F.col("volume") / F.avg("volume").over(mom.frame(-59, 0)))}, {"s21": f"CASE WHEN count(volume) {fr(-20, 0)} = 21 THEN sum(volume) {fr(-20, 0)} END", "s60": f"CASE WHEN count(volume) {fr(-59, 0)} = 60 THEN sum(volume) {fr(-59, 0)} END", "vlog": f"ln(volume / avg(volume) {fr(-59, 0)})"})
column_query("sig_realised_vol", lambda: {"vol": F.coalesce(F.stddev_samp("lret").over(mom.frame(-89, 0)) * 252**0.5, F.lit(0.30))}, {"vol": f"coalesce(stddev_samp(lret) {fr(-89, 0)} * {ROOT}, 0.30)"})


@query("+x AS (SELECT *, ln(volume) AS lv, abs(ret) / dvol AS amihud FROM rets), c AS (SELECT date, abs(lret) AS a, amihud, corr(lret, lv) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vp, t FROM x) SELECT date, round(avg(a), 6) AS agg_abs_ret, round(ln(1 + 1e6 * median(amihud)), 6) AS agg_amihud_log, round(avg(vp), 6) AS agg_vp_corr FROM c WHERE t > 25 GROUP BY date HAVING count(*) > 3")
def sig_microstructure(spark, sf_dir):
    x = with_returns(spark, sf_dir).withColumn("lv", F.ln("volume")).withColumn("amihud", F.abs("ret") / F.col("dvol"))
    x = x.withColumn("vp", signals.safe_corr("lret", "lv", mom.frame(-20, 0))).where("t > 25")
    g = x.groupBy("date").agg(F.avg(F.abs("lret")).alias("a"), F.expr("percentile(amihud, 0.5)").alias("m"), F.avg("vp").alias("vp"), F.count("*").alias("n")).where("n > 3")
    return g.select("date", r6("a").alias("agg_abs_ret"), r6(F.log1p(1e6 * F.col("m"))).alias("agg_amihud_log"), r6("vp").alias("agg_vp_corr"))


POSITIVE, NEGATIVE = ["the", "tion", "est"], ["ing", "les", "und"]
_COUNT = lambda words: " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}.0" for w in words)


@query(f"!SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END, 6) AS score FROM (SELECT doc_id, {_COUNT(POSITIVE)} AS p, {_COUNT(NEGATIVE)} AS n FROM documents)")
def sig_keyword_sentiment(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", r6(signals.polarity(F.col("text"), POSITIVE, NEGATIVE)).alias("score"))


@query("!SELECT event_type, q, round(avg(m), 6) AS score, count(*) AS n FROM (SELECT event_type, user_id, CAST(last_day(CAST(date_trunc('quarter', ts) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS q, avg(value) AS m FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def sig_quarter_mean(spark, sf_dir):
    per = read(spark, sf_dir, "events").groupBy("event_type", "user_id", functions.quarter_end(F.to_date("ts")).alias("q")).agg(F.avg("value").alias("m"))
    return per.groupBy("event_type", "q").agg(r6(F.avg("m")).alias("score"), F.count("*").alias("n"))


# --- preparation ------------------------------------------------------------------------------------------------------
@query("+y AS (SELECT ticker, t, close, coalesce(dividend / lag(close) OVER (PARTITION BY ticker ORDER BY t), 0) AS y FROM panel) SELECT ticker, t, round(close * exp(sum(ln(1 + y)) OVER w), 4) AS tri, round(close * (1 + sum(y) OVER w), 4) AS tri_sum FROM y WINDOW w AS (PARTITION BY ticker ORDER BY t)")
def prep_total_return(spark, sf_dir):
    return prep.with_total_return(panel(spark, sf_dir)).select("ticker", "t", r6("tri", 4), r6("tri_sum", 4))


@query("+g AS (SELECT d.date, k.ticker FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT DISTINCT ticker FROM panel) k), j AS (SELECT g.ticker, g.date, p.close FROM g LEFT JOIN panel p ON g.ticker = p.ticker AND g.date = p.date) SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS filled FROM j")
def prep_scaffold_fill(spark, sf_dir):
    return prep.scaffold(panel(spark, sf_dir)).select("ticker", "date", prep.forward_fill("close").alias("filled"))


@query("+a AS (SELECT ticker, date AS ex_date, 2.0 AS factor FROM panel WHERE t % 500 = 0) SELECT p.ticker, p.date, round(p.close / coalesce(exp((SELECT sum(ln(factor)) FROM a WHERE a.ticker = p.ticker AND a.ex_date > p.date)), 1), 6) AS adj_close FROM panel p")
def prep_split_adjust(spark, sf_dir):
    p = panel(spark, sf_dir)
    actions = p.where("t % 500 = 0").select("ticker", F.col("date").alias("ex_date"), F.lit(2.0).alias("factor"))
    return prep.split_adjusted(p, actions).select("ticker", "date", r6("adj_close"))


@query("+r AS (SELECT ticker, t, close / lag(close) OVER (PARTITION BY ticker ORDER BY t) AS raw FROM panel), s AS (SELECT r.ticker, r.t, r.raw, f.f, row_number() OVER (PARTITION BY r.ticker, r.t ORDER BY abs(f.f - r.raw), f.f) AS rn FROM r CROSS JOIN (SELECT unnest([1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 100.0]) AS f) f WHERE raw > 1.4) SELECT ticker, t, round(CASE WHEN abs(f - raw) <= 0.2 * f THEN f ELSE raw END, 6) AS factor FROM s WHERE rn = 1")
def prep_infer_factor(spark, sf_dir):
    raw = panel(spark, sf_dir).withColumn("raw", F.col("close") / F.lag("close").over(by_ticker())).where("raw > 1.4")
    return raw.select("ticker", "t", r6(prep.snap_factor(F.col("raw"))).alias("factor"))


@query("+j AS (SELECT ticker, t, close, CASE WHEN ret > 2 OR ret < -2.0 / 3 THEN ln(1 + ret) ELSE 0 END AS jump FROM rets) SELECT ticker, t, round(ln(repaired), 6) AS log_repaired FROM (SELECT ticker, t, close * exp(coalesce(sum(jump) OVER (PARTITION BY ticker ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS repaired FROM j)")
def prep_jump_repair(spark, sf_dir):
    return prep.jump_ratios(panel(spark, sf_dir)).select("ticker", "t", r6(F.ln("repaired")).alias("log_repaired"))


@query("SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, max(gap) AS max_gap, round(max(abs(ret)), 6) AS max_move FROM (SELECT ticker, date, ret, CAST(date - lag(date) OVER (PARTITION BY ticker ORDER BY t) AS BIGINT) AS gap FROM rets) GROUP BY ticker")
def prep_coverage(spark, sf_dir):
    return prep.coverage(panel(spark, sf_dir)).select("ticker", "n", "first", "last", F.col("max_gap").cast("long"), r6("max_move"))


@query("+m AS (SELECT ticker, t, round(avg(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS level FROM panel), r AS (SELECT ticker, t, level, level / lag(level) OVER (PARTITION BY ticker ORDER BY t) - 1 AS ret FROM m) SELECT ticker, days, moves FROM (SELECT ticker, count(level) AS days, CAST(sum(CASE WHEN abs(ret) > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS moves FROM r GROUP BY ticker) WHERE days >= 252 AND moves <= 3 ORDER BY days DESC, ticker LIMIT 100")
def prep_quality_gate(spark, sf_dir):
    """At the operator's own thresholds, over each ticker's 60-day mean: single closes of this panel jump too far for any to pass."""
    level = panel(spark, sf_dir).select("ticker", "t", F.round(F.avg("close").over(mom.frame(-59, 0)), 6).alias("close"))
    return prep.quality_gate(level)


@query("!SELECT p_name, trim(replace(lower(p_name), 'part', '')) AS name, p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND NOT regexp_matches(lower(p_name), '(7|9)')")
def prep_master_filter(spark, sf_dir):
    low = F.lower("p_name")
    return read(spark, sf_dir, "part").where(low.contains("a") & ~low.rlike("(7|9)")).select("p_name", F.trim(F.replace(low, F.lit("part"), F.lit(""))).alias("name"), "p_partkey")


for unit in ("month", "week"):

    @query(f"SELECT ticker, CAST(date_trunc('{unit}', date) AS DATE) AS period, arg_max(close, date) AS close FROM panel GROUP BY 1, 2", f"prep_resample_{unit}")
    def _resample(spark, sf_dir, unit=unit):
        return prep.resample(panel(spark, sf_dir), unit)


@query("+m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS close FROM panel GROUP BY 1, 2) SELECT * FROM m WHERE period IN (SELECT period FROM m GROUP BY period HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM m))")
def prep_common_months(spark, sf_dir):
    return prep.common_periods(prep.resample(panel(spark, sf_dir)))


@query("+s AS (SELECT ticker AS key, date, close AS nav, 1 AS priority FROM panel WHERE t <= 400 UNION ALL SELECT ticker, date, close * 2, 2 FROM panel WHERE t > 380) SELECT key, date, nav, priority FROM (SELECT *, row_number() OVER (PARTITION BY key, date ORDER BY priority DESC) AS rn FROM s) WHERE rn = 1")
def prep_stitch(spark, sf_dir):
    p = panel(spark, sf_dir)
    a = p.where("t <= 400").select(F.col("ticker").alias("key"), "date", F.col("close").alias("nav"), F.lit(1).alias("priority"))
    b = p.where("t > 380").select(F.col("ticker").alias("key"), "date", (F.col("close") * 2).alias("nav"), F.lit(2).alias("priority"))
    return prep.stitched(a.unionByName(b))


@query("SELECT ticker, date, close FROM panel WHERE date >= (SELECT max(date) FROM panel) - 730")
def prep_last_years(spark, sf_dir):
    p = panel(spark, sf_dir)
    last = p.agg(F.max("date").alias("m"))  # one row
    return p.join(F.broadcast(last), F.col("date") >= F.date_sub("m", 730)).select("ticker", "date", "close")


@query("SELECT ticker, count(*) AS n FROM panel WHERE ticker LIKE 'E%' OR ticker LIKE 'S%' GROUP BY ticker")
def prep_theme_prefix(spark, sf_dir):
    return panel(spark, sf_dir).where(F.col("ticker").startswith("E") | F.col("ticker").startswith("S")).groupBy("ticker").agg(F.count("*").alias("n"))


# --- risk -------------------------------------------------------------------------------------------------------------
DD = "+dd AS (SELECT ticker, t, date, close, ret, close / max(close) OVER (PARTITION BY ticker ORDER BY t) - 1 AS dd FROM rets)"


@query(DD + " SELECT ticker, round(min(dd), 6) AS max_dd, round(arg_max(dd, t), 6) AS current_dd, round(sqrt(avg(dd * dd)), 6) AS ulcer, round(avg(abs(dd)), 6) AS pain FROM dd GROUP BY ticker")
def risk_drawdown(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("dd", risk.drawdown())
    return rows.groupBy("ticker").agg(r6(F.min("dd")).alias("max_dd"), r6(F.max_by("dd", "t")).alias("current_dd"), r6(F.sqrt(F.avg(F.col("dd") * F.col("dd")))).alias("ulcer"), r6(F.avg(F.abs("dd"))).alias("pain"))


@query("+r AS (SELECT a.ticker, a.t AS rt, p.t, p.close / max(p.close) OVER (PARTITION BY a.ticker, a.t ORDER BY p.t) - 1 AS dd FROM panel a JOIN panel p ON a.ticker = p.ticker AND p.t > a.t - 252 AND p.t <= a.t) SELECT ticker, rt, round(sqrt(avg(dd * dd)), 6) AS ulcer, round(min(dd), 6) AS max_dd, count(*) AS n FROM r GROUP BY ticker, rt")
def risk_restarting_year(spark, sf_dir):
    p = panel(spark, sf_dir)
    return risk.restarting(p, p.select("ticker", F.col("t").alias("rt"))).select("ticker", "rt", r6("ulcer"), r6("max_dd"), "n")


@query(DD + ", s AS (SELECT ticker, count(*) AS n, arg_min(close, t) AS f, arg_max(close, t) AS l, avg(ret) AS m, stddev_pop(ret) AS v, sqrt(avg(dd * dd)) AS u, min(dd) AS d FROM dd GROUP BY ticker) SELECT ticker, round(l / f - 1, 6) AS total, round(pow(l / f, 252.0 / n) - 1, 6) AS cagr, round(m / v * sqrt(252), 6) AS sharpe, round(u, 6) AS ulcer, round((pow(l / f, 252.0 / n) - 1) / u, 6) AS martin, round((pow(l / f, 252.0 / n) - 1) / -d, 6) AS calmar FROM s")
def risk_curve_summary(spark, sf_dir):
    s = risk.curve_summary(panel(spark, sf_dir), ["ticker"], "close")
    return s.select("ticker", *[r6(c) for c in ("total", "cagr", "sharpe", "ulcer", "martin", "calmar")])


@query(DD + ", f AS (SELECT *, dd < -0.3 AS u, CASE WHEN (dd < -0.3) <> coalesce(lag(dd < -0.3) OVER (PARTITION BY ticker ORDER BY t), NOT (dd < -0.3)) THEN 1 ELSE 0 END AS c FROM dd), i AS (SELECT ticker, u, sum(c) OVER (PARTITION BY ticker ORDER BY t) AS island FROM f), r AS (SELECT ticker, island, count(*) AS len FROM i WHERE u GROUP BY ticker, island) SELECT ticker, count(*) AS spells, max(len) AS longest, round(avg(len), 6) AS mean_len FROM r GROUP BY ticker")
def risk_underwater_spells(spark, sf_dir):
    return risk.underwater_spells(panel(spark, sf_dir), -0.3).select("ticker", "spells", "longest", r6("mean_len"))


@query("+y AS (SELECT ticker, t, close / lag(close, 252) OVER (PARTITION BY ticker ORDER BY t) - 1 AS r FROM panel) SELECT ticker, round(min(r), 6) AS worst, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative FROM y WHERE r IS NOT NULL GROUP BY ticker")
def risk_rolling_year(spark, sf_dir):
    y = panel(spark, sf_dir).withColumn("r", mom.no_skip(252)).where("r IS NOT NULL")
    g = y.groupBy("ticker").agg(F.min("r").alias("worst"), F.avg("r").alias("mean"), F.expr("percentile(r, array(0.25, 0.5, 0.75))").alias("p"), F.avg((F.col("r") < 0).cast("double")).alias("negative"))
    return g.select("ticker", r6("worst"), r6("mean"), *[r6(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate((25, 50, 75))], r6("negative"))


@query("+b AS (SELECT ticker, lead(close, 21) OVER (PARTITION BY ticker ORDER BY t) / close - 1 AS r, t FROM panel), p AS (SELECT ticker, quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM b WHERE t % 21 = 0 AND r IS NOT NULL GROUP BY ticker) SELECT b.ticker, round(max(v95), 6) AS var95, round(max(v99), 6) AS var99, round(avg(CASE WHEN r <= v95 THEN r END), 6) AS cvar95, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss_share, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS gain_share FROM b JOIN p ON b.ticker = p.ticker WHERE t % 21 = 0 AND r IS NOT NULL GROUP BY b.ticker")
def risk_monthly_var(spark, sf_dir):
    b = panel(spark, sf_dir).withColumn("r", F.lead("close", 21).over(by_ticker()) / F.col("close") - 1).where("t % 21 = 0")
    return risk.tail_risk(b, ["ticker"], "r").select("ticker", *[r6(c) for c in ("var95", "var99", "cvar95", "loss_share", "gain_share")])


@query("SELECT a.ticker AS a, b.ticker AS b, round(corr(a.ret, b.ret), 6) AS corr FROM rets a JOIN rets b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def risk_correlations(spark, sf_dir):
    return risk.correlations(with_returns(spark, sf_dir)).select("a", "b", r6("corr"))


@query("!WITH x AS (SELECT o_orderkey, (o_orderkey % 97) / 97.0 AS p, (o_orderkey % 53) / 100.0 - 0.05 AS c, o_orderkey % 41 AS m, -(o_orderkey % 61) / 100.0 AS d, (o_orderkey % 11) / 100.0 AS tail, (o_orderkey % 101) / 100.0 AS w, o_orderkey % 7 AS n FROM orders), y AS (SELECT *, abs(d) * m / 12 AS l FROM x) SELECT o_orderkey, round(CASE WHEN n < 3 OR c <= 0 OR p <= 0 THEN -1 ELSE p * (CASE WHEN c < 0.10 THEN 0 WHEN c < 0.25 THEN (c - 0.10) / 0.15 ELSE 1 + least(0.4, (c - 0.25) / 0.50) END) * (CASE WHEN m <= 12 THEN 1.0 WHEN m <= 24 THEN 1 - 0.6 * (m - 12) / 12 WHEN m <= 36 THEN 0.4 - 0.37 * (m - 24) / 12 ELSE 0.03 END) * (CASE WHEN l <= 0.10 THEN 1.0 WHEN l <= 0.50 THEN 1 - 0.5 * (l - 0.10) / 0.40 WHEN l <= 0.80 THEN 0.5 - 0.45 * (l - 0.50) / 0.30 ELSE 0.05 END) * (1 - tail) * (CASE WHEN w < 0.5 THEN 0.5 + w ELSE 1 + least(0.3, w - 0.7) END) END, 5) AS score FROM y")
def risk_composite_score(spark, sf_dir):
    k = F.col("o_orderkey")
    score = risk.composite_score(k % 97 / 97.0, k % 53 / 100.0 - 0.05, k % 41, -(k % 61) / 100.0, k % 11 / 100.0, k % 101 / 100.0, k % 7)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 5).alias("score"))


# --- ranking and allocation -------------------------------------------------------------------------------------------


@query("!SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def rank_top_per_group(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf_dir, "part").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("p_brand", "p_partkey")


@query("!WITH x AS (SELECT s_nationkey AS k, s_suppkey AS ticker, 1.0 + s_suppkey % 7 AS w, 10.0 + s_suppkey % 5 AS cap FROM supplier), o AS (SELECT *, sum(cap) OVER p - cap AS capped, sum(w) OVER (PARTITION BY k) - sum(w) OVER p + w AS open FROM x WINDOW p AS (PARTITION BY k ORDER BY cap / w, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), l AS (SELECT *, (30.0 - capped) / open AS lvl FROM o), b AS (SELECT *, min(CASE WHEN lvl <= cap / w THEN lvl END) OVER (PARTITION BY k) AS bind FROM l) SELECT k, ticker, round(greatest(CASE WHEN bind IS NULL THEN cap ELSE least(cap, bind * w) END, 0), 6) AS alloc FROM b")
def alloc_water_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("ticker"), (1.0 + F.col("s_suppkey") % 7).alias("weight"), (10.0 + F.col("s_suppkey") % 5).alias("cap"))
    return allocation.water_fill(rows, ["k"], 30.0).select("k", "ticker", r6("alloc"))


@query("!WITH s AS (SELECT p_partkey AS ticker, p_retailprice AS score, p_brand AS group_id FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, ticker) AS rn FROM s) SELECT ticker, score FROM r WHERE rn <= 3")
def alloc_group_limit(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return allocation.group_limit(p.select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("score")), p.select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("group_id"), F.lit(3).alias("max_picks")))


@query("!WITH h AS (SELECT l_partkey AS ticker, sum(l_discount) AS w FROM lineitem GROUP BY 1) SELECT p_partkey AS ticker, p_retailprice AS score FROM part WHERE p_partkey NOT IN (SELECT ticker FROM h WHERE w > 1.505)")
def alloc_overlap_block(spark, sf_dir):
    held = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_discount").alias("weight"))
    return allocation.overlap_block(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("score")), held, 1.505)


@query("!SELECT o_orderkey, round_even(o_totalprice / 1000, 0) * 1000 AS rounded, CAST(greatest(1, floor(o_totalprice / (37.5 * 100))) AS BIGINT) AS contracts FROM orders")
def alloc_rounding(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", allocation.round_to(F.col("o_totalprice")).alias("rounded"), functions.contracts(F.col("o_totalprice"), F.lit(37.5)).cast("long").alias("contracts"))


@query("!SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / sum(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def alloc_summary(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("pos"))
    return g.select("c_mktsegment", "n", r6("mean", 4), "low", "high", r6(F.col("pos") / F.sum("pos").over(Window.partitionBy())).alias("share"))


# --- simulation -------------------------------------------------------------------------------------------------------
SWITCH = "+c AS (SELECT ticker, t, close, close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY t) - 1 AS chg FROM panel), s AS (SELECT *, CASE WHEN chg IS NULL THEN 'MOMENTUM' ELSE coalesce(last_value(CASE WHEN chg < -0.2 THEN 'CASH' WHEN chg > 0.4 THEN 'MOMENTUM' END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'MOMENTUM') END AS signal FROM c)"


def switched(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("chg", mom.no_skip(21))
    return rows.withColumn("signal", simulation.switch(F.col("chg"), -0.2, 0.4))


@query(SWITCH + " SELECT ticker, t, signal FROM s")
def sim_switch(spark, sf_dir):
    return switched(spark, sf_dir).select("ticker", "t", "signal")


@query(SWITCH + ", e AS (SELECT ticker, t, CASE WHEN lag(signal) OVER w = 'MOMENTUM' THEN ln(close / lag(close) OVER w) ELSE 0 END AS g FROM s WINDOW w AS (PARTITION BY ticker ORDER BY t)) SELECT ticker, t, round(l, 6) AS log_equity FROM (SELECT ticker, t, ln(1000) + sum(g) OVER (PARTITION BY ticker ORDER BY t) AS l FROM e)")
def sim_switch_equity(spark, sf_dir):
    return switched(spark, sf_dir).withColumn("e", F.ln(simulation.equity_under())).select("ticker", "t", r6("e").alias("log_equity"))


@query(SWITCH + " SELECT ticker, CAST(sum(CASE WHEN signal <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches, CAST(sum(CASE WHEN signal = 'CASH' AND p = 'MOMENTUM' THEN 1 ELSE 0 END) AS BIGINT) AS sells FROM (SELECT ticker, signal, lag(signal) OVER (PARTITION BY ticker ORDER BY t) AS p FROM s) GROUP BY ticker")
def sim_switch_counts(spark, sf_dir):
    rows = switched(spark, sf_dir).withColumn("p", F.lag("signal").over(by_ticker()))
    return rows.groupBy("ticker").agg(F.sum(F.when(F.col("signal") != F.col("p"), 1).otherwise(0)).alias("switches"), F.sum(F.when((F.col("signal") == "CASH") & (F.col("p") == "MOMENTUM"), 1).otherwise(0)).alias("sells"))


@query("!WITH o AS (SELECT l_returnflag AS key, l_suppkey AS ticker, round(sum(l_discount), 2) AS w, round(avg(l_tax), 4) - 0.04 AS gain FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), n AS (SELECT l_returnflag AS key, l_suppkey AS ticker, round(sum(l_tax), 2) AS w2 FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2), j AS (SELECT coalesce(o.key, n.key) AS key, coalesce(w2, 0) - coalesce(w, 0) AS m, coalesce(gain, 0) AS g FROM o FULL JOIN n ON o.key = n.key AND o.ticker = n.ticker) SELECT key, round(sum(abs(m)), 4) AS turnover, round(sum(abs(m) * 0.001 + greatest(-m, 0) * greatest(g, 0) * 0.2), 4) AS cost FROM j GROUP BY key")
def sim_rebalance_cost(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    old = li.where("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("ticker")).agg(F.round(F.sum("l_discount"), 2).alias("w"), (F.round(F.avg("l_tax"), 4) - 0.04).alias("gain"))
    new = li.where("l_linenumber = 2").groupBy(F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("ticker")).agg(F.round(F.sum("l_tax"), 2).alias("w"))
    return simulation.rebalance_cost(old, new).select("key", r6("turnover", 4), r6("cost", 4))


@query("!SELECT o_orderkey, round(CASE WHEN g <= 0 THEN 0 WHEN m >= 12 THEN 0.125 * greatest(g - 125000, 0) ELSE 0.2 * g END, 6) AS tax FROM (SELECT o_orderkey, o_totalprice - 100000 AS g, o_orderkey % 24 AS m FROM orders)")
def sim_tax(spark, sf_dir):
    tax = simulation.taxed_sale(F.col("o_totalprice") - 100000, F.col("o_orderkey") % 24)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(tax, 6).alias("tax"))


@query("+q AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM rets WHERE ret IS NOT NULL AND t <= 1000) SELECT ticker, round(max(CASE WHEN rn = CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) + 1 THEN ret END), 6) AS low, round(max(CASE WHEN rn = CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) + 1 THEN ret END), 6) AS high FROM q GROUP BY ticker")
def sim_train_quantiles(spark, sf_dir):
    """Nearest-rank thresholds from the training rows."""
    w = Window.partitionBy("ticker")
    q = with_returns(spark, sf_dir).where("ret IS NOT NULL AND t <= 1000").withColumn("rn", F.row_number().over(w.orderBy("ret"))).withColumn("n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("rn") == F.floor((F.col("n") - 1) * p + 0.5) + 1, F.col("ret")))
    return q.groupBy("ticker").agg(r6(at(0.25)).alias("low"), r6(at(0.75)).alias("high"))


# --- Monte Carlo ------------------------------------------------------------------------------------------------------


# --- sweeps, aggregates, reports --------------------------------------------------------------------------------------
@query("!SELECT CAST(86625 AS BIGINT) AS configs, CAST(1375 AS BIGINT) AS signatures, CAST(58905 AS BIGINT) AS without_earnings")
def sweep_grid(spark, sf_dir):
    g = sweep.full_grid(spark).select("*", sweep.signature().alias("s"))
    return g.agg(F.count("*").alias("configs"), F.count_distinct("s").alias("signatures"), F.sum((~F.col("profile").contains("earnings")).cast("long")).alias("without_earnings"))


@query("!WITH p AS (SELECT unnest(['p_brand', 'p_type', 'p_size']) AS param, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value, p_retailprice AS m FROM part), g AS (SELECT param, value, avg(m) AS mean FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY round(mean, 8) DESC, value) AS rn, count(*) OVER (PARTITION BY param) AS k FROM g), q AS (SELECT *, greatest(k // 4, 1) AS q FROM r) SELECT param, max(k) AS n_values, round((avg(CASE WHEN rn <= q THEN mean END) - avg(CASE WHEN rn > k - q THEN mean END)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS importance FROM q GROUP BY param")
def agg_param_importance(spark, sf_dir):
    return sweep.importance(read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_retailprice").select("param", "n_values", r6("importance"))


@query("!SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_type")
def agg_group_mean(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("!SELECT floor(c_acctbal / 200) * 200 AS bin, count(*) AS n, max(c_acctbal) AS best FROM customer GROUP BY 1 HAVING count(*) >= 3")
def agg_frontier_bins(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy((F.floor(F.col("c_acctbal") / 200) * 200).cast("double").alias("bin")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("best"))
    return g.where("n >= 3")


@query("SELECT date, round(sum(dvol) / 1e7, 6) AS crores, count(*) AS n FROM panel GROUP BY date")
def agg_traded_value(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("date").agg(r6(F.sum("dvol") / 1e7).alias("crores"), F.count("*").alias("n"))


@query("!WITH h AS (SELECT DISTINCT l_suppkey AS fund, l_partkey AS symbol FROM lineitem), z AS (SELECT fund, count(*) AS n FROM h GROUP BY fund) SELECT a.fund AS a, b.fund AS b, count(*) AS common, round(count(*) * 1.0 / least(max(za.n), max(zb.n)), 6) AS share FROM h a JOIN h b ON a.symbol = b.symbol AND a.fund < b.fund JOIN z za ON za.fund = a.fund JOIN z zb ON zb.fund = b.fund GROUP BY 1, 2")
def join_fund_overlap(spark, sf_dir):
    h = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fund"), F.col("l_partkey").alias("symbol")).distinct()
    z = h.groupBy("fund").agg(F.count("*").alias("n"))
    a, b = h.select(F.col("fund").alias("a"), "symbol"), h.select(F.col("fund").alias("b"), "symbol")
    c = a.join(b, "symbol").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    c = c.join(z.select(F.col("fund").alias("a"), F.col("n").alias("na")), "a").join(z.select(F.col("fund").alias("b"), F.col("n").alias("nb")), "b")
    return c.select("a", "b", "common", r6(F.col("common") / F.least("na", "nb")).alias("share"))


@query("SELECT ticker, coalesce(min(CASE WHEN abs(close / 1500 - 1) <= 0.05 THEN date END), arg_min(date, abs(close - 1500))) AS entry FROM panel GROUP BY ticker")
def join_entry_date(spark, sf_dir):
    near = F.min(F.when(F.abs(F.col("close") / 1500 - 1) <= 0.05, F.col("date")))
    return panel(spark, sf_dir).groupBy("ticker").agg(F.coalesce(near, F.min_by("date", F.abs(F.col("close") - 1500))).alias("entry"))


@query("!SELECT c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey AND o_totalprice > 100000")
def join_left(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey", "o_orderkey")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("!SELECT coalesce(a.k, b.k) AS k, a.n AS n1, b.n AS n2 FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def join_full_outer(spark, sf_dir):
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n1"))
    b = read(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n2"))
    return a.join(b, "k", "full_outer")


@query("!SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS active FROM customer")
def join_semi_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("active", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("active", F.lit(False)))


@query("!(SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def set_operations(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    a = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("k"))
    return a.intersect(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))).exceptAll(s.where("s_nationkey = 3").select(F.col("s_suppkey").alias("k")))


@query("!SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def sort_head(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("!WITH x AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8 + p_size / 100.0) AS k, 0.25 AS y, 0.05 AS r, 0.3 AS v FROM part), d AS (SELECT *, (ln(s / k) + (r + v * v / 2) * y) / (v * sqrt(y)) AS d1 FROM x), e AS (SELECT *, d1 - v * sqrt(y) AS d2 FROM d), n AS (SELECT *, 1 / (1 + 0.2316419 * abs(d1)) AS t1, 1 / (1 + 0.2316419 * abs(d2)) AS t2 FROM e), c AS (SELECT *, 1 - exp(-d1 * d1 / 2) / 2.5066282746310002 * t1 * (0.319381530 + t1 * (-0.356563782 + t1 * (1.781477937 + t1 * (-1.821255978 + t1 * 1.330274429)))) AS u1, 1 - exp(-d2 * d2 / 2) / 2.5066282746310002 * t2 * (0.319381530 + t2 * (-0.356563782 + t2 * (1.781477937 + t2 * (-1.821255978 + t2 * 1.330274429)))) AS u2 FROM n), p AS (SELECT *, CASE WHEN d1 >= 0 THEN u1 ELSE 1 - u1 END AS n1, CASE WHEN d2 >= 0 THEN u2 ELSE 1 - u2 END AS n2 FROM c) SELECT p_partkey, round(k * exp(-r * y) * (1 - n2) - s * (1 - n1), 4) AS put, round(s * n1 - k * exp(-r * y) * n2, 4) AS call, round(n1 - 1, 5) AS put_delta FROM p")
def fn_black_scholes(spark, sf_dir):
    s, k = F.col("p_retailprice"), F.col("p_retailprice") * (0.8 + F.col("p_size") / 100.0)
    args = (s, k, F.lit(0.25), F.lit(0.05), F.lit(0.3))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(functions.black_scholes(*args), 4).alias("put"), F.round(functions.black_scholes(*args, kind="call"), 4).alias("call"), F.round(functions.delta(*args), 5).alias("put_delta"))


@query("!SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS quarter_end, round(pow(1 + o_totalprice / 1e6, 1 / 252.0) - 1, 8) AS daily, CAST(sign(o_totalprice - 100000) AS INTEGER) AS side FROM orders")
def fn_dates_and_rates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.trunc(d, "month").alias("month"), functions.quarter_end(d).alias("quarter_end"), F.round(functions.daily_rate(F.col("o_totalprice") / 1e6), 8).alias("daily"), F.signum(F.col("o_totalprice") - 100000).cast("int").alias("side"))


@query("!SELECT s_suppkey, CAST(floor(s_acctbal / 7.5) AS BIGINT) AS shares, round(s_acctbal / 1000 - 1, 6) AS gain, CASE WHEN s_acctbal / 1000 - 1 > 0.2 THEN 'above' WHEN s_acctbal / 1000 - 1 < -0.2 THEN 'below' ELSE 'inside' END AS band FROM supplier")
def fn_positions(spark, sf_dir):
    gain = F.col("s_acctbal") / 1000 - 1
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") / 7.5).alias("shares"), r6(gain).alias("gain"), F.when(gain > 0.2, "above").when(gain < -0.2, "below").otherwise("inside").alias("band"))


@query("!SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return streaming.tumbling(read(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("!WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return streaming.sessions(read(spark, sf_dir, "events"))


# further plans register themselves
from tidemark.plans import allocations, funds, montecarlo, preparation, reports, scoring, search, simulations  # noqa: E402, F401
