"""Sources, lookups, positions, windows, folds and derived features."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import bindings as b
from contract import views as v
from contract.registry import query
from curvewalk.operators import features as fx
from curvewalk.operators import folds, panel
from curvewalk.operators.curve import COEFFICIENTS, TENOR_NAMES, yields_percent
from curvewalk.operators.folds import WalkForward
from curvewalk.sources import tables

CONFIG = str(Path(__file__).with_name("features.json"))
COEFS = " ".join(COEFFICIENTS)
WHOLE_ROW = " ".join([*b.FEATURES, *b.TARGETS])
W, R = b.PLAN.window, b.PLAN.refit_every


def _config_values() -> str:
    config = json.loads(Path(CONFIG).read_text())
    rows = []
    for name, entry in config.items():
        if name == "dependent_variables":
            rows += [f"(null, 'target', {i}, '{c}')" for i, c in enumerate(entry)]
        else:
            for role, label in (("max_features", "max"), ("other_features", "other")):
                rows += [f"('{name}', '{label}', {i}, '{c}')" for i, c in enumerate(entry[role])]
    return "config(horizon, role, ordinal, column_name) as (values " + ", ".join(rows) + ")"


_COLUMNS = [*b.FEATURES, *b.TARGETS]
_LONG = "long3 as (" + " union all ".join(f"select '{c}' as column_name, {c} as value from v3" for c in _COLUMNS) + ")"
_COLUMN_STATS = "stats as (select column_name, count(value) as n_rows, avg(value) as mean from long3 group by column_name)"


def _column_stats(spark: SparkSession, sf: str) -> DataFrame:
    long = b.panel(spark, sf).unpivot([], _COLUMNS, "column_name", "value")
    return long.groupBy("column_name").agg(F.count("value").alias("n_rows"), F.avg("value").alias("mean"))


@query(
    sql="select o_orderkey, cast(o_orderdate as date) as date, o_totalprice from orders",
    doubles="o_totalprice",
)
def a1_validated_source(spark, sf):
    df = tables.table_source(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate", "o_totalprice"])
    return df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")


@query(sql=f"with {v.V3} select series_id, date, {', '.join(_COLUMNS)} from v3", doubles=WHOLE_ROW)
def a2_load_panel(spark, sf):
    return panel.load_panel(b.featured(spark, sf), b.FEATURES, b.TARGETS)


@query(
    sql=f"with {v.V3}, {_LONG}, {_COLUMN_STATS}, {_config_values()} select horizon, role, ordinal, config.column_name, n_rows, mean from config join stats on config.column_name = stats.column_name",
    doubles="mean",
)
def a3_config_coverage(spark, sf):
    return tables.feature_config(spark, CONFIG).join(_column_stats(spark, sf), "column_name")


@query(
    sql=f"with {v.V3} select series_id, date, beta0, beta1, beta0_moving_avg_5 from v3",
    doubles="beta0 beta1 beta0_moving_avg_5",
)
def a4_horizon_features(spark, sf):
    names = tables.features(tables.feature_config(spark, CONFIG), "one-day-ahead")
    return b.panel(spark, sf).select("series_id", "date", *names)


@query(sql=f"with {v.V3} select series_id, date, {', '.join(b.TARGETS)} from v3", doubles=" ".join(b.TARGETS))
def a5_target_columns(spark, sf):
    names = tables.targets(tables.feature_config(spark, CONFIG))
    return b.panel(spark, sf).select("series_id", "date", *names)


@query(
    sql=f"with {v.V3}, {_LONG}, {_COLUMN_STATS}, {_config_values()} select horizon, count(*) as n_columns, min(n_rows) as n_rows from config join stats on config.column_name = stats.column_name where horizon is not null group by horizon"
)
def a6_horizons(spark, sf):
    config = tables.feature_config(spark, CONFIG)
    known = config.join(tables.horizons(config), "horizon", "left_semi")
    return (
        known.join(_column_stats(spark, sf), "column_name")
        .groupBy("horizon")
        .agg(F.count("*").alias("n_columns"), F.min("n_rows").alias("n_rows"))
    )


@query(
    sql=f"with {v.V3} select series_id, date, beta0, beta1, beta0_moving_avg_5, beta2, lambda_ from v3",
    doubles="beta0 beta1 beta0_moving_avg_5 beta2 lambda_",
)
def a7_other_features(spark, sf):
    names = tables.features(tables.feature_config(spark, CONFIG), "one-day-ahead", ("max", "other"))
    return b.panel(spark, sf).select("series_id", "date", *names)


@query(
    sql=f"with {v.V5} select date, " + ", ".join(f"max(case when tenor = '{t}' then yield_pct end) as \"{t}\"" for t in TENOR_NAMES) + " from v5 group by date",
    doubles=" ".join(TENOR_NAMES),
)
def a15_observed_yields(spark, sf):
    return b.daily_curve(spark, sf).select("date", *yields_percent())


@query(
    sql=f"with {v.F3} select series_id, date, beta0_lag, beta0_future_val from f3 where beta0_lag is not null and beta0_future_val is not null",
    doubles="beta0_lag beta0_future_val",
)
def b1_complete_rows(spark, sf):
    rows = b.featured(spark, sf).select("series_id", "date", "beta0_lag", "beta0_future_val")
    return panel.complete_rows(rows, ["beta0_lag", "beta0_future_val"])


@query(
    sql=f"with {v.V3} select series_id, date, pos, beta0, beta0_future_val from v3 where pos >= 100 and pos < 350",
    doubles="beta0 beta0_future_val",
)
def b2_position_slice(spark, sf):
    return panel.position_slice(b.panel(spark, sf), 100, 350, ["beta0", "beta0_future_val"])


@query(
    sql=f"with {v.V3} select series_id, date, pos, {', '.join(b.FEATURES)} from v3 where pos = 150",
    doubles=" ".join(b.FEATURES),
)
def b3_prediction_point(spark, sf):
    return panel.at_position(b.panel(spark, sf), 150, b.FEATURES)


@query(
    sql=f"with {v.V3} select series_id, date, pos, {', '.join(b.TARGETS)} from v3 where pos = 150",
    doubles=" ".join(b.TARGETS),
)
def b4_actual_value(spark, sf):
    return panel.at_position(b.panel(spark, sf), 150, b.TARGETS)


@query(sql=f"with {v.V3} select series_id, date, pos from v3 where pos = 0")
def b5_date_at_position(spark, sf):
    return panel.at_position(b.panel(spark, sf), 0, [])


@query(
    sql=f"with {v.V5}, {v.V3} select date, tenor, yield_pct from v5 where date between (select min(date) from v3) and (select max(date) from v3)",
    doubles="yield_pct",
)
def b6_date_range(spark, sf):
    observed = b.observed_yields(spark, sf).select("date", "tenor", "yield_pct")
    return panel.within_dates_of(observed, b.panel(spark, sf))


@query(
    sql=f"with {v.V5} select date, " + ", ".join(f"max(case when tenor = '{t}' then yield_pct end) as \"{t}_actual\", max(case when tenor = '{t}' then yield_pct end)/2 as \"{t}_prediction\"" for t in TENOR_NAMES) + " from v5 group by date",
    doubles=" ".join(f"{t}_actual {t}_prediction" for t in TENOR_NAMES),
)
def b10_suffix_columns(spark, sf):
    rows = b.daily_curve(spark, sf)
    halves = [(c / 2).alias(f"{t}_prediction") for c, t in zip(yields_percent(), TENOR_NAMES)]
    return rows.select("date", *yields_percent(suffix="_actual"), *halves)


@query(sql=f"with {v.V2} select series_id, date, pos, pos_total from v2")
def c1_positions(spark, sf):
    return b.positioned_curves(spark, sf).select("series_id", "date", "pos", "pos_total")


@query(
    sql=f"with {v.V3} select series_id, pos - {W} as k, pos, (pos - {W}) // {R} as fold, pos - {W} as train_start, pos as train_end, (pos - {W}) % {R} = 0 as retrain from v3 where pos >= {W}"
)
def c2_windows(spark, sf):
    return folds.windows(b.panel(spark, sf), b.PLAN)


@query(
    sql=f"with {v.V3}, t as (select *, pos - greatest({W}, pos_total - 10) as k from v3) select series_id, k, pos, k // {R} as fold, pos - {W} as train_start, pos as train_end, k % {R} = 0 as retrain from t where k >= 0"
)
def c3_last_windows(spark, sf):
    return folds.windows(b.panel(spark, sf), WalkForward(W, 100, R, last_n=10))


@query(
    sql=f"""with {v.V3}, t as (select *, pos - {W + 7} as since from v3 where pos >= {W + 7})
 select series_id, since // 5 as k, pos, since // 5 // 6 as fold, pos - 7 - {W} as train_start, pos - 7 as train_end,
  since // 5 % 6 = 0 as retrain from t where since % 5 = 0"""
)
def c4_refit_schedule(spark, sf):
    return folds.windows(b.panel(spark, sf), WalkForward(W, 100, 6, step=5, embargo=7))


@query(sql=f"with {v.TRAIN} select series_id, fold, pos from train")
def c5_training_rows(spark, sf):
    return folds.training_rows(b.panel(spark, sf), b.PLAN).select("series_id", "fold", "pos")


@query(
    sql=f"with {v.V3} select w.series_id, w.pos, p.date from (select series_id, pos from v3 where pos >= {W}) as w join v3 as p on p.series_id = w.series_id and p.pos = w.pos"
)
def c6_prediction_dates(spark, sf):
    placed = b.panel(spark, sf)
    ahead = folds.windows(placed, b.PLAN).select("series_id", F.col("train_end").alias("pos"))
    return ahead.join(placed.select("series_id", "pos", "date"), ["series_id", "pos"])


def _derived(spark, sf, derivations) -> DataFrame:
    placed = b.positioned_curves(spark, sf)
    return fx.derive(placed, derivations).select("series_id", "date", *derivations)


@query(
    sql=f"with {v.V2} select series_id, date, lead(beta0, 30) over (partition by series_id order by date) as beta0_future_val from v2",
    doubles="beta0_future_val",
)
def d1_future_value(spark, sf):
    return _derived(spark, sf, {"beta0_future_val": fx.future("beta0", 30)})


@query(
    sql=f"with {v.V2} select series_id, date, lag(beta1) over (partition by series_id order by date) as beta1_lag from v2",
    doubles="beta1_lag",
)
def d2_lag(spark, sf):
    return _derived(spark, sf, {"beta1_lag": fx.lag("beta1")})


@query(
    sql=f"with {v.V2} select series_id, date, {v.trailing('beta0', 30)} as beta0_moving_avg_30, {v.trailing('beta0', 60)} as beta0_moving_avg_60, {v.trailing('lambda_', 200)} as lambda_200_day_avg from v2",
    doubles="beta0_moving_avg_30 beta0_moving_avg_60 lambda_200_day_avg",
)
def d3_moving_average(spark, sf):
    return _derived(
        spark,
        sf,
        {
            "beta0_moving_avg_30": fx.moving_average("beta0", 30),
            "beta0_moving_avg_60": fx.moving_average("beta0", 60),
            "lambda_200_day_avg": fx.moving_average("lambda_", 200),
        },
    )


def _ema(span: int) -> str:
    keep = f"{1.0 - 2.0 / (span + 1)!r}::double"
    return f"""select now.series_id, now.date, sum(old.beta0*power({keep}, now.pos - old.pos))/sum(power({keep}, now.pos - old.pos)) as beta0_exp_moving_avg_{span}
 from v2 as now join v2 as old on old.series_id = now.series_id and old.pos <= now.pos group by now.series_id, now.date"""


@query(sql=f"with {v.V2} {_ema(30)}", doubles="beta0_exp_moving_avg_30")
def d4_exponential_average(spark, sf):
    return _derived(spark, sf, {"beta0_exp_moving_avg_30": fx.exponential_average("beta0", 30)})


@query(
    sql=f"with {v.V5} select date, max(case when tenor = 'DGS2' then yield_pct end) - max(case when tenor = 'DGS10' then yield_pct end) as spread_2yr_10yr from v5 group by date",
    doubles="spread_2yr_10yr",
)
def d5_curve_spread(spark, sf):
    wide = b.daily_curve(spark, sf).select("date", *yields_percent())
    return fx.spreads(wide, {"spread_2yr_10yr": ("DGS2", "DGS10")}).select("date", "spread_2yr_10yr")


@query(
    sql=f"with {v.V2}, m as (select series_id, date, {v.trailing('beta0', 30)} as a, {v.trailing('beta1', 30)} as c from v2) select series_id, date, a - c as spread_beta0_vs_beta1 from m",
    doubles="spread_beta0_vs_beta1",
)
def d6_average_pair_spread(spark, sf):
    averages = _derived(
        spark, sf, {"beta0_avg": fx.moving_average("beta0", 30), "beta1_avg": fx.moving_average("beta1", 30)}
    )
    out = fx.spreads(averages, {"spread_beta0_vs_beta1": ("beta0_avg", "beta1_avg")})
    return out.select("series_id", "date", "spread_beta0_vs_beta1")


@query(
    sql=f"with {v.V2} select series_id, date, {v.trailing('beta0', 30)} - {v.trailing('beta0', 200)} as beta0_ma_spread from v2",
    doubles="beta0_ma_spread",
)
def d7_moving_average_spread(spark, sf):
    return _derived(spark, sf, {"beta0_ma_spread": fx.average_spread("beta0", 30, 200)})


_STATS = ["beta0", "beta1", "beta2", "lambda_", "beta0_future_val"]


@query(
    sql=f"with {v.V3} " + " union all ".join(
        f"select '{c}' as column_name, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, max({c}) as max from v3"
        for c in _STATS
    ),
    doubles="mean std min q25 q50 q75 max",
)
def h15_describe(spark, sf):
    return panel.describe(b.panel(spark, sf), _STATS)


@query(sql=f"with {v.V3} select min(date) as min_date, max(date) as max_date from v3")
def h16_date_range(spark, sf):
    return panel.date_range(panel.load_panel(b.featured(spark, sf), b.FEATURES, b.TARGETS))


@query(
    sql=f"with {v.V1} select year(date)::int as year, count(*) as n_dates, avg(beta0) as mean_beta0 from v1 group by year(date)",
    doubles="mean_beta0",
)
def a9_date_from_path(spark, sf):
    """Curves stored under year folders; the year is read back from the file path."""
    path = tables.shared_folder(spark, "dated-curves")
    dated = b.daily_curve(spark, sf).select("date", "beta0", F.year("date").alias("year"))
    tables.write_table(dated, path, ["year"])
    stored = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    from_path = F.regexp_extract(F.col("_metadata.file_path"), r"year=(\d+)", 1).cast("int")
    return (
        stored.select("beta0", from_path.alias("year"))
        .groupBy("year")
        .agg(F.count("*").alias("n_dates"), F.avg("beta0").alias("mean_beta0"))
    )


@query(
    sql=f"with {v.V1} select make_date(year(date), 12, 31) as date, count(*) as n_dates, avg(beta0) as mean_beta0 from v1 group by all",
    doubles="mean_beta0",
)
def a9_dated_files(spark, sf):
    """One table for each year of curves, named after its last day and without a date inside."""
    path = tables.shared_folder(spark, "dated-files")
    curves = tables.materialize(b.daily_curve(spark, sf), "daily-curve")
    for row in curves.select(F.year("date").alias("year")).distinct().collect():
        curves.where(F.year("date") == row.year).drop("date").write.parquet(f"{path}/{row.year}-12-31.parquet")
    stored = tables.read_dated_files(spark, f"{path}/*")
    return stored.groupBy("date").agg(F.count("*").alias("n_dates"), F.avg("beta0").alias("mean_beta0"))
