"""Monte-Carlo paths of every ticker, with SQL that draws the same integers, and the hidden Markov model's regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hmm, montecarlo
from tidemark.operators import momentum as mom
from tidemark.plans.registry import query, r6, universe, with_returns

M = montecarlo.MODULUS


def histories(spark, sf_dir) -> DataFrame:
    """(ticker, i, r): the returns of every ticker, 0-based."""
    rows = with_returns(spark, sf_dir).where("ret IS NOT NULL")
    return rows.select("ticker", (F.col("t") - 2).alias("i"), F.round("ret", 8).alias("r"))


def _paths_sql(paths: int, horizon: int, block: int, seed: int, last: int = 1) -> str:
    return f"""+h AS (SELECT ticker, t - 2 AS i, round(ret, 8) AS r FROM rets WHERE ret IS NOT NULL), z AS (SELECT ticker, count(*) AS n FROM h GROUP BY ticker HAVING count(*) > {block - last}),
b AS (SELECT ticker, path, b, ((({seed} * 48271 + path * 16807 + 11) % {M} * 48271 + b * 16807 + 11) % {M} * 48271) % {M} % (n - {block} + {last}) AS start FROM z, (SELECT unnest(range(0, {paths})) AS path), (SELECT unnest(range(0, {-(-horizon // block)})) AS b)),
p AS (SELECT b.ticker, path, b * {block} + o AS step, h.r FROM b, (SELECT unnest(range(0, {block})) AS o) o JOIN h ON h.ticker = b.ticker AND h.i = start + o.o WHERE b * {block} + o.o < {horizon})""".replace("\n", " ")


METRICS = ", lv AS (SELECT ticker, path, step, sum(ln(greatest(1 + r, 1e-12))) OVER (PARTITION BY ticker, path ORDER BY step) AS l FROM {0}), dd AS (SELECT *, exp(l - max(l) OVER (PARTITION BY ticker, path ORDER BY step)) - 1 AS d FROM lv), m AS (SELECT ticker, path, arg_max(l, step) AS growth, min(d) AS max_dd, sqrt(avg(d * d)) AS ulcer FROM dd GROUP BY 1, 2)"
PERCENTILES = "round(quantile_cont({0}, 0.05), 6) AS p5, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, round(quantile_cont({0}, 0.95), 6) AS p95, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std"


@query(_paths_sql(2000, 252, 21, 7) + METRICS.format("p") + " SELECT ticker, path, round(growth, 6) AS growth, round(max_dd, 6) AS max_dd, round(ulcer, 6) AS ulcer FROM m")
def mc_block_paths(spark, sf_dir):
    """2000 paths of a year of every ticker; growth is the logarithm of one plus the total return."""
    m = montecarlo.path_metrics(montecarlo.block_paths_each(histories(spark, sf_dir), 2000, 252, 21, 7), ["ticker"])
    return m.select("ticker", "path", r6("growth"), r6("max_dd"), r6("ulcer"))


@query(_paths_sql(2000, 252, 21, 7) + ", g AS (SELECT ticker, path, sum(ln(greatest(1 + r, 1e-12))) AS growth FROM p GROUP BY 1, 2) SELECT ticker, " + PERCENTILES.format("growth") + " FROM g GROUP BY ticker")
def mc_percentiles(spark, sf_dir):
    totals = montecarlo.path_totals(montecarlo.block_paths_each(histories(spark, sf_dir), 2000, 252, 21, 7), ["ticker"])
    p = montecarlo.percentiles(totals, "growth", ["ticker"])
    return p.select("ticker", *[r6(c) for c in p.columns[1:]])


@query(_paths_sql(1000, 252, 1, 5) + ", g AS (SELECT ticker, path, sum(ln(greatest(1 + r, 1e-12))) AS growth FROM p GROUP BY 1, 2) SELECT ticker, " + PERCENTILES.format("growth") + " FROM g GROUP BY ticker")
def mc_iid_percentiles(spark, sf_dir):
    totals = montecarlo.path_totals(montecarlo.block_paths_each(histories(spark, sf_dir), 1000, 252, 1, 5), ["ticker"])
    p = montecarlo.percentiles(totals, "growth", ["ticker"])
    return p.select("ticker", *[r6(c) for c in p.columns[1:]])


@query(_paths_sql(1000, 252, 5, 3, 0) + ", g AS (SELECT ticker, path, sum(ln(greatest(1 + r, 1e-12))) AS growth FROM p GROUP BY 1, 2) SELECT ticker, " + PERCENTILES.format("growth") + " FROM g GROUP BY ticker")
def mc_loop_blocks(spark, sf_dir):
    totals = montecarlo.path_totals(montecarlo.block_paths_each(histories(spark, sf_dir), 1000, 252, 5, 3, last_block=False), ["ticker"])
    p = montecarlo.percentiles(totals, "growth", ["ticker"])
    return p.select("ticker", *[r6(c) for c in p.columns[1:]])


_REG = " UNION ALL ".join(f"SELECT '{n}' AS regime, p.ticker, p.path, (r - own) * {k} + own + {'0' if d is None else f'pow({1 + d}, 1 / 252.0) - 1 - grand'} AS r FROM p JOIN o ON p.ticker = o.ticker AND p.path = o.path JOIN gr ON gr.ticker = p.ticker" for n, d, k in montecarlo.REGIMES)


@query(_paths_sql(1000, 756, 21, 7) + f", o AS (SELECT ticker, path, avg(r) AS own FROM p GROUP BY 1, 2), gr AS (SELECT ticker, avg(r) AS grand FROM p GROUP BY 1), q AS ({_REG}), g AS (SELECT regime, ticker, path, sum(ln(greatest(1 + r, 1e-12))) AS growth FROM q GROUP BY 1, 2, 3) SELECT regime, ticker, round(quantile_cont(growth, 0.05), 5) AS p5, round(quantile_cont(growth, 0.5), 5) AS p50, round(quantile_cont(growth, 0.95), 5) AS p95, round(avg(growth), 5) AS mean FROM g GROUP BY 1, 2")
def mc_regimes(spark, sf_dir):
    """1000 paths of three years of every ticker under four regimes."""
    paths = montecarlo.block_paths_each(histories(spark, sf_dir), 1000, 756, 21, 7)
    totals = montecarlo.path_totals(montecarlo.retargeted(paths, montecarlo.regimes(spark), ["ticker"]), ["regime", "ticker"])
    return montecarlo.percentiles(totals, "growth", ["regime", "ticker"]).select("regime", "ticker", *[r6(c, 5) for c in ("p5", "p50", "p95", "mean")])


#: Crash buckets of the query: frequency a year, magnitude, days.
CRASHES = [(0.5, -0.15, 42), (0.2, -0.30, 84), (0.05, -0.50, 120)]
_BUCKETS = " UNION ALL ".join(f"SELECT {i} AS bucket, {f} AS frequency, {m} AS magnitude, {d} AS duration" for i, (f, m, d) in enumerate(CRASHES))
_DRAW = lambda seed: f"((({seed} * 48271 + path * 16807 + 11) % {M} * 48271 + bucket * 16807 + 11) % {M} * 48271) % {M}"


@query(_paths_sql(2000, 252, 1, 7) + f", bu AS ({_BUCKETS}), hit AS (SELECT path, magnitude, duration, {_DRAW(12)} % greatest(252 - duration, 1) AS start FROM (SELECT unnest(range(0, 2000)) AS path), bu WHERE {_DRAW(11)} / {float(M)} < least(0.99, frequency)), sp AS (SELECT path, start, least(252, start + duration) AS stop, pow(1 + magnitude, 1.0 / (least(252, start + duration) - start)) - 1 AS drag FROM hit), ad AS (SELECT path, step, sum(drag) AS drag FROM sp JOIN (SELECT unnest(range(0, 252)) AS step) ON step >= start AND step < stop GROUP BY 1, 2), c AS (SELECT p.ticker, p.path, p.step, p.r + coalesce(drag, 0) AS r FROM p LEFT JOIN ad ON ad.path = p.path AND ad.step = p.step)" + METRICS.format("c") + " SELECT ticker, " + PERCENTILES.format("max_dd") + " FROM m GROUP BY ticker")
def mc_crash_injection(spark, sf_dir):
    rows = [F.struct(F.lit(i).alias("bucket"), F.lit(f).alias("frequency"), F.lit(m).alias("magnitude"), F.lit(d).alias("duration")) for i, (f, m, d) in enumerate(CRASHES)]
    buckets = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    hit = montecarlo.crash_injected(montecarlo.block_paths_each(histories(spark, sf_dir), 2000, 252, 1, 7), buckets, 252, 11, ["ticker"])
    p = montecarlo.percentiles(montecarlo.path_metrics(hit, ["ticker"]), "max_dd", ["ticker"])
    return p.select("ticker", *[r6(c) for c in p.columns[1:]])


BASKETS = {"one": ["ECONOMY"], "three": ["ECONOMY", "PROMO", "SMALL"], "all": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
HORIZONS = [63, 126, 252]
_BASKETS = " UNION ALL ".join(f"SELECT '{b}' AS basket, '{t}' AS ticker, {i + 1}.0 AS w" for b, names in BASKETS.items() for i, t in enumerate(names))


@query(f"+wt AS ({_BASKETS}), dy AS (SELECT basket, date, sum(w * ret) / sum(w) AS r FROM rets JOIN wt ON wt.ticker = rets.ticker WHERE ret IS NOT NULL GROUP BY 1, 2), h AS (SELECT basket AS ticker, row_number() OVER (PARTITION BY basket ORDER BY date) - 1 AS i, r FROM dy), z AS (SELECT ticker, count(*) AS n FROM h GROUP BY 1), b AS (SELECT ticker, path, b, (((9 * 48271 + path * 16807 + 11) % {M} * 48271 + b * 16807 + 11) % {M} * 48271) % {M} % n AS start FROM z, (SELECT unnest(range(0, 1000)) AS path), (SELECT unnest(range(0, 252)) AS b)), p AS (SELECT b.ticker || '/' || hz AS ticker, path, b AS step, h.r FROM b JOIN h ON h.ticker = b.ticker AND h.i = start, (SELECT unnest({HORIZONS}) AS hz) WHERE b < hz)" + METRICS.format("p") + " SELECT split_part(ticker, '/', 1) AS basket, CAST(split_part(ticker, '/', 2) AS INTEGER) AS horizon, " + ", ".join(f"round(ln(quantile_cont(exp(growth), {q / 100})), 6) AS p{q}" for q in (5, 25, 50, 75, 95)) + ", round(quantile_cont(max_dd, 0.05), 6) AS worst_dd, round(avg(CASE WHEN growth < ln(0.8) THEN 1.0 ELSE 0.0 END), 6) AS big_loss, round(avg(CASE WHEN growth < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss FROM m GROUP BY ticker")
def mc_baskets(spark, sf_dir):
    """Three baskets over three horizons, from days drawn one by one; percentiles as logarithms."""
    rows = [F.struct(F.lit(b).alias("basket"), F.lit(t).alias("ticker"), F.lit(i + 1.0).alias("w")) for b, names in BASKETS.items() for i, t in enumerate(names)]
    weights = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    out = montecarlo.baskets(with_returns(spark, sf_dir), weights, 1000, HORIZONS, 9)
    return out.select("basket", "horizon", *[r6(F.ln(c)).alias(c) for c in ("p5", "p25", "p50", "p75", "p95")], *[r6(c) for c in ("worst_dd", "big_loss", "loss")])


@query("+y AS (SELECT ticker, t, exp(sum(lret) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) - 1 AS r, count(lret) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS n FROM rets) SELECT ticker, t, round(ln(1 + r), 6) AS growth FROM y WHERE n = 63")
def mc_rolling_history(spark, sf_dir):
    """Growth over the 63 days before each day, where there are so many."""
    span = mom.frame(-63, -1)
    rows = with_returns(spark, sf_dir).withColumn("growth", F.sum("lret").over(span)).withColumn("n", F.count("lret").over(span))
    return rows.where("n = 63").select("ticker", "t", r6("growth"))


@query(f"@en AS (SELECT entry, 273 + ((13 * 48271 + entry * 16807 + 11) % {M} * 48271) % {M} % greatest((SELECT max(t) FROM panel) - 756 - 273 + 1, 1) AS start FROM (SELECT unnest(range(0, 200)) AS entry)), x AS (SELECT ticker, entry, t, start, close / first_value(close) OVER w AS v FROM panel JOIN en ON t >= start AND t < start + 756 WINDOW w AS (PARTITION BY ticker, entry ORDER BY t)), d AS (SELECT *, v / max(v) OVER (PARTITION BY ticker, entry ORDER BY t) - 1 AS dd FROM x), u AS (SELECT *, CASE WHEN dd < -0.001 THEN t - max(CASE WHEN dd >= -0.001 THEN t END) OVER (PARTITION BY ticker, entry ORDER BY t) ELSE 0 END AS run FROM d), s AS (SELECT ticker, entry, arg_max(v, t) - 1 AS total, min(dd) AS max_dd, max(run) AS streak, sum(CASE WHEN v < 0.9 THEN 1 ELSE 0 END) AS b10, sum(CASE WHEN v < 0.8 THEN 1 ELSE 0 END) AS b20 FROM u GROUP BY 1, 2) SELECT ticker, round(quantile_cont(total, 0.5), 6) AS p50_total, round(quantile_cont(max_dd, 0.05), 6) AS p5_dd, round(quantile_cont(streak, 0.5), 6) AS p50_streak, round(quantile_cont(streak, 0.95), 6) AS p95_streak, round(avg(b10), 6) AS days_below_10, round(avg(b20), 6) AS days_below_20 FROM s GROUP BY ticker")
def mc_underwater(spark, sf_dir):
    """Time under water from 200 random entries over three years, the same entries for every curve (here: each ticker held)."""
    curve = universe(spark, sf_dir).select(F.col("ticker").alias("config_id"), "t", F.col("close").alias("value"))
    m = montecarlo.underwater(curve, montecarlo.entry_points(curve, 200, 756, 273, 13), 756)
    g = m.groupBy(F.col("config_id").alias("ticker")).agg(F.expr("percentile(total, 0.5)").alias("p50_total"), F.expr("percentile(max_dd, 0.05)").alias("p5_dd"), F.expr("percentile(streak, array(0.5, 0.95))").alias("s"), F.avg("below_10").alias("days_below_10"), F.avg("below_20").alias("days_below_20"))
    return g.select("ticker", r6("p50_total"), r6("p5_dd"), r6(F.col("s")[0]).alias("p50_streak"), r6(F.col("s")[1]).alias("p95_streak"), r6("days_below_10"), r6("days_below_20"))


@query(None)
def model_hmm_regimes(spark, sf_dir):
    """Three states of every ticker, refitted every 252 days, from returns and their rolling volatility."""
    rows = with_returns(spark, sf_dir)
    features = rows.select("ticker", "t", F.coalesce("lret", F.lit(0.0)).alias("f0"), F.coalesce(F.stddev_pop("lret").over(mom.frame(-20, 0)), F.lit(0.0)).alias("f1"))
    return hmm.regimes(features)
