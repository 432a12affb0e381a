"""Scores, ranks and allocations over the aligned universe: tickers meet on dates, each with its own days up to then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import allocation, prep, scoring, sweep
from tidemark.operators import momentum as mom
from tidemark.plans.registry import CLIP, NEG, ORACLE_SQL, ROOT, YEAR, fr, lag, query, r6, universe
from tidemark.sources.panel import aligned, panel

#: Days between rebalances, and the first of them.
STEP, WARM = 21, 252

short = lambda lb, skip=21: f"coalesce({lag(skip)} / {lag(skip + lb - 1)} - 1, 0)"
SPAN, DAYS = fr(-272, -21), fr(-271, -20)

#: The scorer in SQL: m has the measures of each own day, sc the scores of the asked (ticker, rt, t) in `asked`.
MEASURES = f"""orets AS (SELECT ticker, date, n AS t, close, dvol, close / lag(close) OVER (PARTITION BY ticker ORDER BY n) - 1 AS ret FROM own),
m1 AS (SELECT *, {short(21)} AS mom_1m, {short(63)} AS mom_3m, {short(126)} AS mom_6m, {short(252)} AS mom_12m, coalesce(stddev_pop({NEG}) OVER w * {ROOT}, 1e-4) AS dn_vol,
  regr_slope(ln(close), t) {SPAN} AS slope, regr_r2(ln(close), t) {SPAN} AS r2, regr_syy(ln(close), t) {SPAN} AS syy, regr_sxx(ln(close), t) {SPAN} AS sxx, regr_sxy(ln(close), t) {SPAN} AS sxy, regr_count(ln(close), t) {SPAN} AS points,
  coalesce(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) {DAYS}, 0.5) AS fip, close / max(close) OVER w - 1 AS current_dd, close / max(close) {fr(-62, 0)} - 1 AS depth,
  CASE WHEN t >= 252 THEN 1 - close / max(close) {YEAR} END AS dist52, CASE WHEN t >= 60 THEN avg(dvol) {fr(-59, 0)} ELSE 0 END AS adv60,
  CASE WHEN t >= 63 THEN regr_slope(ln(dvol), t) {fr(-62, 0)} * 252 ELSE 0 END AS dv_slope
  FROM orets WINDOW w AS (PARTITION BY ticker ORDER BY t)),
m2 AS (SELECT *, min(current_dd) OVER w AS max_dd, CASE WHEN t > 63 THEN min(depth) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE min(current_dd) OVER w END AS worst_3m_dd,
  CASE WHEN current_dd < 0 THEN t - max(CASE WHEN current_dd >= 0 THEN t END) OVER w ELSE 0 END AS spell FROM m1 WINDOW w AS (PARTITION BY ticker ORDER BY t)),
m AS (SELECT *, max(spell) OVER w AS max_dd_dur, coalesce(sum(CASE WHEN spell > 0 THEN 1.0 ELSE 0.0 END) OVER w / nullif(sum(CASE WHEN spell = 1 THEN 1 ELSE 0 END) OVER w, 0), 0) AS avg_dd_dur FROM m2 WINDOW w AS (PARTITION BY ticker ORDER BY t))"""
SCORES = f"""{MEASURES}, pairs AS (SELECT DISTINCT ticker, t FROM asked WHERE t >= 84),
yr AS (SELECT ticker, upto, sqrt(avg(dd * dd)) AS ulcer_1y, min(dd) AS max_dd_1y FROM (SELECT a.ticker, a.t AS upto, o.close / max(o.close) OVER (PARTITION BY a.ticker, a.t ORDER BY o.t) - 1 AS dd
  FROM pairs a JOIN orets o ON o.ticker = a.ticker AND o.t > a.t - 252 AND o.t <= a.t) GROUP BY 1, 2),
s1 AS (SELECT m.*, ulcer_1y, max_dd_1y, 0.2 * mom_3m + 0.4 * mom_6m + 0.4 * mom_12m AS wt_mom, CASE WHEN points >= 20 AND syy > 0 THEN greatest(r2, 0) ELSE 0 END AS quality,
  CASE WHEN points >= 20 THEN slope * 252 ELSE 0 END AS baltas_slope, CASE WHEN points >= 20 THEN coalesce(slope / nullif(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (points - 2)) / sqrt(sxx), 0), 0) ELSE 0 END AS baltas_tstat,
  sign(mom_3m) + sign(mom_6m) + sign(mom_12m) AS wtmf_composite, least(greatest(1 + 0.15 * dv_slope, 0.7), 1.3) AS vol_factor,
  CASE WHEN dist52 IS NULL THEN 1.0 WHEN dist52 < 0.10 THEN 1.10 WHEN dist52 < 0.25 THEN 1.0 ELSE greatest(0.85, 1.0 - 0.5 * (dist52 - 0.25)) END AS high_factor
  FROM m JOIN yr ON yr.ticker = m.ticker AND yr.upto = m.t),
s2 AS (SELECT *, sqrt(quality * fip) AS smoothness, CASE WHEN ulcer_1y > 0.001 THEN wt_mom / ulcer_1y ELSE 0 END AS martin FROM s1),
sc AS (SELECT *, wt_mom * smoothness / dn_vol AS score_pricemom, mom_12m * smoothness / dn_vol AS score_12_1, CASE WHEN abs(baltas_tstat) > 1.5 THEN baltas_slope ELSE 0 END * quality / dn_vol AS score_baltas,
  abs(wtmf_composite) / 3 * wt_mom * smoothness / dn_vol AS score_wtmf, wt_mom * smoothness / dn_vol * vol_factor * high_factor AS score_sortino, martin * smoothness * vol_factor * high_factor AS score_martin,
  martin * smoothness * vol_factor * high_factor AS score, close AS latest_price FROM s2)"""
ASKED = f"asked AS (SELECT ticker, t AS rt, n AS t FROM panel WHERE t >= {WARM} AND (t - {WARM}) % {STEP} = 0), {SCORES}, f AS (SELECT a.rt, sc.* EXCLUDE (score), round(score_sortino, 8) AS score FROM asked a JOIN sc ON sc.ticker = a.ticker AND sc.t = a.t)"

#: The same at the last date: `sc` has its scores.
LIVE = f"asked AS (SELECT ticker, t AS rt, n AS t FROM panel WHERE t = (SELECT max(t) FROM panel)), {SCORES}"


def rebalances(rows: DataFrame) -> DataFrame:
    """The calendar numbers of rebalance days."""
    return rows.select("t").distinct().where((F.col("t") >= WARM) & ((F.col("t") - WARM) % STEP == 0))


def scores_at(spark: SparkSession, sf_dir: str, days: DataFrame | None = None, key: str = "p_brand") -> DataFrame:
    """rt and the scorer's outputs of every ticker at the given (default: every rebalance) day; `score` is the Sortino score, to eight places."""
    own = panel(spark, sf_dir, key)
    market = aligned(own)
    asked = scoring.as_of(market, rebalances(market) if days is None else days)
    table = scoring.score_table(own.withColumn("ret", mom.simple_return()), asked)
    # a row a ticker and rebalance, which plans rank, gate and hold in turn
    return asked.join(table, ["ticker", "t"]).withColumn("score", F.round("score_sortino", 8)).persist()


@query("@" + LIVE + " SELECT ticker, t, " + ", ".join(f"round({c}, 5) AS {c}" for c in scoring.OUTPUTS) + " FROM sc")
def score_tickers(spark, sf_dir):
    """Every measure of every ticker at the last date."""
    own = panel(spark, sf_dir, "p_brand")
    last = own.groupBy("ticker").agg(F.max("t").alias("t"))
    table = scoring.score_table(own.withColumn("ret", mom.simple_return()), last)
    return table.select("ticker", "t", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in scoring.OUTPUTS])


@query("@" + ASKED + " SELECT ticker, rt, round(score_pricemom, 6) AS score_pricemom, round(score_sortino, 6) AS score_sortino, round(score_martin, 6) AS score_martin FROM f")
def rank_panel_scores(spark, sf_dir):
    return scores_at(spark, sf_dir).select("ticker", "rt", r6("score_pricemom"), r6("score_sortino"), r6("score_martin"))


@query("@" + LIVE + " SELECT ticker, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, ticker) AS rank FROM (SELECT ticker, round(score_sortino, 8) AS s FROM sc) QUALIFY rank <= 5")
def flagship_top5(spark, sf_dir):
    """Live picks: the five best tickers at the last date."""
    own = panel(spark, sf_dir, "p_brand")
    last = own.groupBy("ticker").agg(F.max("t").alias("t"))
    rows = scoring.score_table(own.withColumn("ret", mom.simple_return()), last).withColumn("score", F.round("score_sortino", 8))
    # one row a ticker is left for this window
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ticker"))).where("rank <= 5").select("ticker", r6("score"), "rank")


@query("@asked AS (SELECT ticker, t AS rt, n AS t FROM panel WHERE date = (SELECT max(date) FROM panel WHERE date <= DATE '2000-06-30')), " + SCORES + " SELECT ticker, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, ticker) AS rank FROM (SELECT ticker, round(score_sortino, 8) AS s FROM sc) WHERE s > 0 QUALIFY rank <= 10")
def rank_picks_as_of(spark, sf_dir):
    """The ten best positive scores as of a past date: its last calendar day."""
    market = aligned(panel(spark, sf_dir, "p_brand"))
    day = market.where(F.col("date") <= F.lit("2000-06-30").cast("date")).agg(F.max("t").alias("t"))
    rows = scores_at(spark, sf_dir, day).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ticker"))).where("rank <= 10").select("ticker", r6("score"), "rank")


@query("@" + ASKED + " SELECT rt, ticker, round(score, 6) AS score, row_number() OVER (PARTITION BY rt ORDER BY score DESC, ticker) AS rank FROM f WHERE score > 0 QUALIFY rank <= 5")
def rank_top_n(spark, sf_dir):
    return scoring.top(scores_at(spark, sf_dir).where("score > 0"), ["rt"], 5).select("rt", "ticker", r6("score"), "rank")


_PCT = lambda c, high: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY rt, up ORDER BY {c} {'ASC' if high else 'DESC'} NULLS LAST) + (count(*) OVER (PARTITION BY rt, up, {c}) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY rt, up) - 1, 1) END"


@query("@" + ASKED + ", g AS (SELECT ticker, rt, " + ", ".join(f"round({c}, 8) AS {c}" for c, _ in scoring.FACTORS) + ", wt_mom > 0 AS up FROM f) SELECT ticker, rt, CASE WHEN up THEN coalesce(round((" + " + ".join(_PCT(c, h) for c, h in scoring.FACTORS) + ") / 5, 6), 0) ELSE 0 END AS score_rank FROM g")
def rank_percentile_mean(spark, sf_dir):
    rows = scores_at(spark, sf_dir).select("ticker", "rt", *[F.round(c, 8).alias(c) for c, _ in scoring.FACTORS])
    return scoring.rank_scores(rows, ["rt"]).select("ticker", "rt", r6("score_rank"))


@query("@" + ASKED + ", c AS (SELECT rt, ticker, score, ticker LIKE 'Brand#1%' AS capped FROM f WHERE score > 0), r AS (SELECT *, row_number() OVER (PARTITION BY rt, capped ORDER BY score DESC, ticker) AS own FROM c) SELECT rt, ticker, row_number() OVER (PARTITION BY rt ORDER BY score DESC, ticker) AS rank FROM r WHERE NOT capped OR own <= 2 QUALIFY rank <= 6")
def rank_top_n_sub_cap(spark, sf_dir):
    rows = scores_at(spark, sf_dir)
    return scoring.top_with_cap(rows, ["rt"], 6, F.col("ticker").startswith("Brand#1"), 2).select("rt", "ticker", "rank")


#: The switched scorer's filters in SQL, at every day of the aligned panel.
CACHE = f"""mkt AS (SELECT t, avg(close) AS p FROM panel GROUP BY t), crash AS (SELECT t, CASE WHEN p / lag(p, 504) OVER (ORDER BY t) - 1 < 0 AND p / lag(p, 21) OVER (ORDER BY t) - 1 > 0.05 THEN 0.5 ELSE 1.0 END AS crash FROM mkt),
cache AS (SELECT r.*, crash, {{momentum}} AS blend, sqrt(CASE WHEN regr_syy(ln(close), r.t) OVER y > 0 THEN regr_r2(ln(close), r.t) OVER y ELSE 0 END * avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) OVER y) AS smooth,
  greatest(stddev_pop({CLIP}) OVER y * {ROOT}, 1e-4) AS dn, greatest(coalesce(stddev_pop(ret) OVER h * {ROOT}, 1e-4), 1e-4) AS tv,
  CASE WHEN lag(close, 272) OVER w IS NULL OR {" + ".join(f"(CASE WHEN lag(close, {20 + 21 * k}) OVER w > lag(close, {41 + 21 * k}) OVER w THEN 1 ELSE 0 END)" for k in range(1, 12))} >= 8 THEN 1.0 ELSE 0.0 END AS steady,
  coalesce(close / first_value(close) OVER b - 1, 0) AS abs12
  FROM rets r JOIN crash c ON c.t = r.t WINDOW w AS (PARTITION BY ticker ORDER BY r.t), y AS (PARTITION BY ticker ORDER BY r.t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), h AS (PARTITION BY ticker ORDER BY r.t ROWS BETWEEN 125 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY r.t ROWS BETWEEN 252 PRECEDING AND CURRENT ROW))"""
MIX = f"0.2 * {short(63)} + 0.4 * {short(126)} + 0.4 * {short(252)}".replace("OVER w", "OVER w")
#: Switch settings that the query scores: each alone, and all at once.
SWITCHES = ["none", "smooth", "sortino", "consistent", "dual", "crash", "sortino+smooth+consistent+dual+crash"]


def _switch_sql(profile: str) -> str:
    on = profile.split("+")
    score = "blend" + (" * smooth" if "smooth" in on else "") + (" / dn" if "sortino" in on else "") + (" * steady" if "consistent" in on else "")
    score = f"(CASE WHEN abs12 > 0 THEN {score} ELSE -1.0 END)" if "dual" in on else f"({score})"
    return f"SELECT '{profile}' AS profile, ticker, t, round(CASE WHEN blend > 0 THEN {score}{' * crash' if 'crash' in on else ''} ELSE -1.0 END, 6) AS score FROM cache WHERE t >= {WARM} AND (t - {WARM}) % {STEP} = 0"


@query("@" + CACHE.format(momentum=MIX) + " " + " UNION ALL ".join(_switch_sql(p) for p in SWITCHES))
def rank_switched_scores(spark, sf_dir):
    """The score with switches, for each profile at each rebalance day: signals are computed once, profiles are rows."""
    market = universe(spark, sf_dir)
    cache = scoring.signal_cache(market, [(63, 21), (126, 21), (252, 21)], ["none"])
    now = cache.join(F.broadcast(rebalances(market)), "t", "left_semi")  # one number a rebalance
    profiles = sweep.profiles(spark, SWITCHES)
    blend = 0.2 * F.col("m_none_63_21") + 0.4 * F.col("m_none_126_21") + 0.4 * F.col("m_none_252_21")
    rows = now.crossJoin(F.broadcast(profiles))  # the profiles are a literal table
    return rows.select("profile", "ticker", "t", r6(scoring.switched(rows, blend, F.col("flags"))).alias("score"))


VARIANT_SQL = f"""v AS (SELECT ticker, t, {{blend}} AS blend, coalesce(nullif(stddev_pop({NEG}) {fr(-273, -22)} * {ROOT}, 0), 1e-4) AS down, coalesce(nullif(stddev_pop(ret) {fr(-273, -22)} * {ROOT}, 0), 1e-4) AS whole,
  abs({" + ".join(f"coalesce(sign(lag(close, 22) OVER w / lag(close, {21 + lb}) OVER w - 1), 0)" for lb in (63, 126, 252))}) AS signs, regr_slope(ln(close), t) {fr(-525, -1)} * 252 AS slope, coalesce(stddev_pop({NEG}) {fr(-524, -1)} * {ROOT}, 1e-4) AS alldown,
  count(*) {fr(-525, -1)} AS before, lag(close, 84) OVER w AS nearest FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY t)),
u AS (SELECT ticker, upto, sqrt(avg(dd * dd)) AS ulcer FROM (SELECT a.ticker, a.t AS upto, p.close / max(p.close) OVER (PARTITION BY a.ticker, a.t ORDER BY p.t) - 1 AS dd FROM v a JOIN panel p ON p.ticker = a.ticker AND p.t < a.t AND p.t >= a.t - 525 WHERE before >= 525 AND a.t % 21 = 0) GROUP BY 1, 2)"""
_AVAILABLE = "(" + " + ".join(f"coalesce({w} * (lag(close, 22) OVER w / lag(close, {21 + lb}) OVER w - 1), 0)" for lb, w in ((63, 0.2), (126, 0.4), (252, 0.4))) + ") / nullif(" + " + ".join(f"(CASE WHEN lag(close, {21 + lb}) OVER w IS NULL THEN 0 ELSE {w} END)" for lb, w in ((63, 0.2), (126, 0.4), (252, 0.4))) + ", 0)"


@query("@" + VARIANT_SQL.format(blend=_AVAILABLE) + " SELECT v.ticker, t, round(blend / down, 6) AS sortino_pricemom, round(blend / whole / down, 6) AS sortino_vnorm, round(signs / 3 * blend / down, 6) AS wtmf, round(CASE WHEN before >= 525 THEN CASE WHEN alldown > 0 THEN slope / alldown ELSE 0 END END, 6) AS baltas, round(CASE WHEN before >= 525 THEN blend / greatest(ulcer, 1e-3) END, 6) AS martin FROM v LEFT JOIN u ON u.ticker = v.ticker AND u.upto = v.t WHERE nearest IS NOT NULL AND blend IS NOT NULL AND t % 21 = 0")
def rank_variant_panel(spark, sf_dir):
    """Five score variants at every check day of the panel."""
    out = scoring.variant_panel(universe(spark, sf_dir), at=F.col("t") % STEP == 0)
    return out.select("ticker", "t", *[r6(c) for c in out.columns[2:]])


WIDE = "concat(p_brand, '/', p_type)"


@query(None)
def rank_wide_panel(spark, sf_dir):
    """The panel's scores over the wide universe, brands by types: some 150 tickers at every rebalance day."""
    return scores_at(spark, sf_dir, key=WIDE).select("ticker", "rt", r6("score_pricemom"), r6("score_sortino"), r6("score_martin"))


ORACLE_SQL["rank_wide_panel"] = ORACLE_SQL["rank_panel_scores"].replace("SELECT p_brand AS ticker", "SELECT p_brand || '/' || p_type AS ticker")
