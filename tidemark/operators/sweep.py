"""Configuration grids as rows, their labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the full grid.
LOOKBACKS = [(10, 42, 126), (21, 63, 252), (42, 126, 252), (63, 126, 252), (21, 42, 63), (126, 252, 504), (252, 504, 756)]
WEIGHTS = [(0.4, 0.4, 0.2), (0.5, 0.3, 0.2), (0.7, 0.2, 0.1), (0.1, 0.3, 0.6), (0.33, 0.34, 0.33)]
SKIPS = [0, 21]
POSITIONS = [2, 3, 5, 8, 10, 15, 30]
FREQUENCIES = [5, 10, 21, 42, 63, 252, 378, 504, 756]
#: The flags of each signal profile, as names joined by '+'.
PROFILES = [
    "none", "sortino", "smooth", "earnings", "basic", "ewma", "volnorm", "accel", "trimmed", "consistent", "dual", "volscale", "crash",
    "sortino+earnings", "earnings+consistent", "dual+volscale", "volscale+crash", "sortino+smooth+earnings+consistent", "earnings+ewma", "earnings+accel",
    "ewma+volscale", "trimmed+volscale", "sortino+volnorm", "sortino+earnings+volnorm", "sortino+smooth+earnings+ewma+consistent+dual+volscale+crash",
]


def _values(spark: SparkSession, name: str, rows: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.lit(rows) if not isinstance(rows[0], tuple) else F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])).alias(name))


def full_grid(spark: SparkSession, earnings: bool = True) -> DataFrame:
    """lookback, weights, skip, profile, positions, frequency: the product of literal tables without lookbacks as short as the skip."""
    grid = _values(spark, "lookback", LOOKBACKS).crossJoin(_values(spark, "weights", WEIGHTS)).crossJoin(_values(spark, "skip", SKIPS))
    grid = grid.where(F.col("lookback")[0] > F.col("skip")).crossJoin(_values(spark, "profile", PROFILES))  # literal tables of fixed length
    if not earnings:
        grid = grid.where(~F.col("profile").contains("earnings"))
    return grid.crossJoin(_values(spark, "positions", POSITIONS)).crossJoin(_values(spark, "frequency", FREQUENCIES))


#: Switches of a profile; the others of its words name the momentum's variant.
FLAGS = ["sortino", "smooth", "earnings", "consistent", "dual", "volscale", "crash"]


def flags(profile: Column) -> Column:
    """A profile's switches as a map from name to boolean."""
    words = F.split(profile, r"\+")
    return F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.array_contains(words, f))])


def variant(profile: Column) -> Column:
    """The momentum variant of a profile, 'none' for plain returns."""
    named = F.filter(F.split(profile, r"\+"), lambda w: ~w.isin(FLAGS))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("none"))


def profiles(spark: SparkSession, names: list[str]) -> DataFrame:
    """(profile, variant, flags) of each name."""
    return _values(spark, "profile", names).select("profile", variant(F.col("profile")).alias("variant"), flags(F.col("profile")).alias("flags"))


def signature() -> Column:
    """What a configuration's score depends on: scored once for all sizes and frequencies."""
    return F.concat_ws("|", F.array_join(F.col("lookback").cast("array<string>"), "/"), F.array_join(F.col("weights").cast("array<string>"), "/"), F.col("skip").cast("string"), "profile")


def label() -> Column:
    return F.concat_ws(" ", F.array_join(F.col("lookback").cast("array<string>"), "/"), F.col("profile"), F.concat(F.lit("n"), F.col("positions")), F.concat(F.lit("f"), F.col("frequency")))


def keep_or_revert(d_martin: Column, d_ulcer: Column) -> Column:
    """Keep a change that raises the Martin ratio without much more ulcer, or lowers the ulcer at little cost."""
    return F.when((d_martin > 0) & (d_ulcer <= 0.005), "keep").when((d_ulcer < -0.005) & (d_martin > -0.1), "keep").otherwise("revert")


def importance(results: DataFrame, params: list[str], metric: str) -> DataFrame:
    """Per parameter: (mean of its best quarter of values - mean of its worst) / the metric's sample deviation."""
    long = results.select(F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params])).alias("x"), F.col(metric).alias("m")).select("x.*", "m")
    groups = long.groupBy("param", "value").agg(F.avg("m").alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy("param")
    ranked = groups.withColumn("rn", F.row_number().over(w.orderBy(F.desc("mean"), "value"))).withColumn("k", F.count("*").over(w)).withColumn("q", F.greatest(F.floor(F.col("k") / 4), F.lit(1)))
    spread = results.agg(F.stddev_samp(metric).alias("sd"))
    out = ranked.groupBy("param").agg(F.avg(F.when(F.col("rn") <= F.col("q"), F.col("mean"))).alias("top"), F.avg(F.when(F.col("rn") > F.col("k") - F.col("q"), F.col("mean"))).alias("bottom"), F.max("k").alias("n_values"))
    return out.join(F.broadcast(spread), how="cross").select("param", "n_values", F.try_divide(F.col("top") - F.col("bottom"), F.col("sd")).alias("importance"))  # spread is one row


#: Fixed values of the smaller grids.
RUN_SCORES, RUN_SIZINGS, RUN_STEPS = ["score_martin", "score_sortino", "score_rank"], ["raw", "sqrt", "equal"], [21, 63, 126]
TACTICAL = {"variant": ["score_1w", "score_2w", "score_4w", "score_8w", "score_eq", "score_tilt", "score_sortino"], "every": [2, 5, 10], "positions": [5, 8, 10], "leverage": [1.0, 1.3, 1.5, 2.0]}
#: The settings that each preset changes.
PRESETS: dict[str, dict] = {
    "S0_baseline_no_adv": {}, "S1_regime_gate": {"regime_gate": True}, "S2_dd_stop_30": {"dd_stop": 0.30}, "S3_dd_stop_35": {"dd_stop": 0.35}, "S4_voltarget_20": {"vol_target": 0.20},
    "S5_voltarget_25": {"vol_target": 0.25}, "S6_regime_dd35": {"regime_gate": True, "dd_stop": 0.35}, "S7_regime_volt20": {"regime_gate": True, "vol_target": 0.20}, "S8_volt20_dd35": {"vol_target": 0.20, "dd_stop": 0.35},
    "S9_all_three_conserv": {"regime_gate": True, "vol_target": 0.20, "dd_stop": 0.35}, "S10_lev13_voltarget": {"leverage": 1.3, "vol_target": 0.18}, "S11_lev15_volt_dd": {"leverage": 1.5, "vol_target": 0.20, "dd_stop": 0.35},
    "S12_no_inpain": {"current_dd_floor": -1.0}, "S13_no_inpain_volt": {"current_dd_floor": -1.0, "vol_target": 0.22}, "S14_no_sleeve_volt": {"use_sleeve_caps": False, "vol_target": 0.20},
}
HYPOTHESES: dict[str, dict] = {
    "baseline": {}, "h1_top5": {"max_positions": 5, "max_pct": 0.30, "min_pct": 0.05}, "h2_top8": {"max_positions": 8, "max_pct": 0.20, "min_pct": 0.05}, "h3_no_sleeves": {"use_sleeve_caps": False}, "h4_no_adv": {"min_adv": 0.0},
    "h5_no_inpain": {"current_dd_floor": -1.0}, "h6_raw_top8": {"max_positions": 8, "max_pct": 0.20, "min_pct": 0.05, "sizing": "raw"}, "h7_leverage_13": {"leverage": 1.3}, "h8_leverage_15": {"leverage": 1.5},
    "h9_rank_top8": {"max_positions": 8, "max_pct": 0.20, "min_pct": 0.05, "score_col": "score_rank", "sizing": "sqrt"}, "h10_aggressive": {"max_positions": 7, "max_pct": 0.25, "min_pct": 0.05, "use_sleeve_caps": False, "sizing": "raw"},
    "h11_max_aggression": {"max_positions": 5, "max_pct": 0.30, "min_pct": 0.05, "use_sleeve_caps": False, "current_dd_floor": -1.0, "leverage": 1.3}, "h12_top20_safe": {"max_positions": 20, "max_pct": 0.10, "min_pct": 0.025},
    "h13_weekly_rebal": {"rebal_days": 5}, "h14_biweekly_rebal": {"rebal_days": 10}, "h15_no_min": {"min_pct": 0.0},
}
#: What a preset leaves as it is.
DEFAULTS = {
    "score_col": "score_sortino", "sizing": "equal", "rebal_days": 21, "max_positions": 15, "max_pct": 0.15, "min_pct": 0.03, "min_adv": 5_000_000.0, "current_dd_floor": -0.25, "use_sleeve_caps": True,
    "leverage": 1.0, "regime_gate": False, "dd_stop": 0.0, "vol_target": 0.0,
}


def runs(spark: SparkSession) -> DataFrame:
    """score, sizing, every: 27 runs."""
    return _values(spark, "score", RUN_SCORES).crossJoin(_values(spark, "sizing", RUN_SIZINGS)).crossJoin(_values(spark, "every", RUN_STEPS))  # literal tables


def tactical(spark: SparkSession) -> DataFrame:
    """variant, every, positions, leverage: 252 configurations."""
    grid = None
    for name, values in TACTICAL.items():  # literal tables
        column = _values(spark, name, values)
        grid = column if grid is None else grid.crossJoin(column)
    return grid


def presets(spark: SparkSession, named: dict[str, dict]) -> DataFrame:
    """A row a preset: its name and every setting."""
    return spark.createDataFrame([{"name": name} | DEFAULTS | changed for name, changed in named.items()])


def validated(config: dict) -> dict:
    """A configuration with its defaults; unknown settings, and shares or windows out of order, raise."""
    unknown = set(config) - set(DEFAULTS) - {"name"}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    whole = DEFAULTS | config
    if not 0 <= whole["min_pct"] < whole["max_pct"] <= 1:
        raise ValueError("min_pct must be below max_pct, both shares")
    if whole["rebal_days"] <= 0 or whole["max_positions"] <= 0 or whole["leverage"] <= 0 or not 0 <= whole["dd_stop"] <= 1:
        raise ValueError("steps, positions and leverage must be positive, a stop a share")
    return whole
