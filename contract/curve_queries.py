"""Curve values, samples, percentiles, means, fits and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import bindings as b
from contract import views as v
from contract.registry import query
from curvewalk.operators import curve, samples
from curvewalk.operators.curve import COEFFICIENTS, TENOR_NAMES, TENORS
from curvewalk.plans import yields
from curvewalk.sources import tables

DRAWS = MANY = 1000
SCALE = 0.01
GROUP = ["series_id", "date"]
TENOR_LIST = " ".join(TENOR_NAMES)
COEFS = " ".join(COEFFICIENTS)


def _forecast(spark, sf):
    """The daily curve as a point forecast with a spread of 5% of each coefficient."""
    rows = b.daily_curve(spark, sf)
    return rows.select(
        *GROUP,
        *[F.col(c).alias(f"prediction_{c}") for c in COEFFICIENTS],
        *[F.abs(F.col(c) * 0.05).alias(f"std_{c}") for c in COEFFICIENTS],
    )


def _samples(spark, sf, n=DRAWS, scale=None):
    return samples.draw_samples(_forecast(spark, sf), COEFFICIENTS, GROUP, n, scale)


SPREAD = "abs({c}*0.05e0)"
MEANS = ", ".join(f'avg({v.curve_value(f"{years}e0")}) as "{name}"' for name, years in TENORS)
PERCENT = """points as (select series_id, date, sample_id, tenor, {value} as yield_pct from samples cross join tenors),
 ranked as (select *, (rank() over (partition by series_id, date, tenor order by yield_pct)
   + (count(*) over (partition by series_id, date, tenor, yield_pct) - 1)/2e0)
   / count(*) over (partition by series_id, date, tenor) as percentile from points)""".format(
    value=v.curve_value("maturity")
)


SPREAD_SQL = "count(*) as n_samples, avg(yield_pct) as mean_yield, min(yield_pct) as low, max(yield_pct) as high"
RANK_SQL = f"{SPREAD_SQL}, sum(percentile*percentile) as squares, sum(percentile*yield_pct) as products"


def _spread_of():
    value = F.col("yield_pct")
    return [
        F.count("*").alias("n_samples"), F.avg(value).alias("mean_yield"), F.min(value).alias("low"), F.max(value).alias("high")
    ]


def _rank_of():
    rank = F.col("percentile")
    return [*_spread_of(), F.sum(rank * rank).alias("squares"), F.sum(rank * F.col("yield_pct")).alias("products")]


RANK_DOUBLES = "mean_yield low high squares products"


@query(sql=f"with {v.V5} select date, ordinal, tenor, yield_pct from v5", doubles="yield_pct")
def e1_curve_value(spark, sf):
    return curve.curve_points(b.daily_curve(spark, sf)).select("date", "ordinal", "tenor", "yield_pct")


@query(
    sql=f"with {v.curve_samples(DRAWS, SPREAD)}, points as (select date, tenor, {v.curve_value('maturity')} as yield_pct from samples cross join tenors) select date, tenor, {SPREAD_SQL} from points group by date, tenor",
    doubles="mean_yield low high",
)
def e2_sample_curves(spark, sf):
    """All draws as curves, summed up per date and tenor."""
    points = curve.curve_points(_samples(spark, sf))
    return points.groupBy("date", "tenor").agg(*_spread_of())


@query(
    sql=f"with {v.curve_samples(DRAWS, SPREAD)}, {PERCENT} select date, tenor, {RANK_SQL} from ranked group by date, tenor",
    doubles=RANK_DOUBLES,
)
def e3_percentile(spark, sf):
    """Percentiles of all draws, summed up per date and tenor: products tie each rank to its yield."""
    ranked = curve.sample_yields(_samples(spark, sf), GROUP, max_group=DRAWS)
    return ranked.groupBy("date", "tenor").agg(*_rank_of())


@query(
    sql=f"with {v.V4} select segment, order_key, (rank() over (partition by segment order by y_true) + (count(*) over (partition by segment, y_true) - 1)/2e0)/count(*) over (partition by segment) as percentile from r4",
    doubles="percentile",
)
def e3_percentile_any_group(spark, sf):
    """Percentile ranks where a group may hold any share of the rows."""
    rows = tables.materialize(b.forecast_rows(spark, sf), "forecast-rows")
    return curve.percentile_ranks(rows, ["segment"], "y_true", None).select("segment", "order_key", "percentile")


@query(
    sql=f"with {v.curve_samples(DRAWS, SPREAD)}, {PERCENT} select date, count(distinct sample_id) as n_samples, "
    + ", ".join(
        f"avg(case when tenor = '{t}' then yield_pct end) as \"{t}\", sum(case when tenor = '{t}' then percentile*percentile end) as \"{t}_percentile\""
        for t in TENOR_NAMES
    )
    + " from ranked group by date",
    doubles=TENOR_LIST + " " + " ".join(f"{t}_percentile" for t in TENOR_NAMES),
)
def e4_all_sample_yields(spark, sf):
    """One row per draw with yields and percentiles of all tenors, summed up per date."""
    wide = curve.sample_yields_wide(_samples(spark, sf), GROUP, max_group=DRAWS)
    sums = [F.avg(t).alias(t) for t in TENOR_NAMES]
    sums += [F.sum(F.col(f"{t}_percentile") * F.col(f"{t}_percentile")).alias(f"{t}_percentile") for t in TENOR_NAMES]
    return wide.groupBy("date").agg(F.count("*").alias("n_samples"), *sums)


@query(
    sql=f"with {v.V2}, p as (select series_id, date, "
    + ", ".join(f"{c} as actual_{c}, lag({c}) over (partition by series_id order by date) as prediction_{c}" for c in COEFFICIENTS)
    + " from v2) select series_id, date, "
    + ", ".join(
        f'{v.curve_value(f"{years}e0", f"{part}_")} as "{name}_{part}"'
        for name, years in TENORS
        for part in ("actual", "prediction")
    )
    + " from p",
    doubles=" ".join(f"{t}_actual {t}_prediction" for t in TENOR_NAMES),
)
def e5_point_curves(spark, sf):
    from curvewalk.operators.features import derive, lag

    placed = derive(b.positioned_curves(spark, sf), {f"prediction_{c}": lag(c) for c in COEFFICIENTS})
    wide = placed.withColumnsRenamed({c: f"actual_{c}" for c in COEFFICIENTS})
    return curve.point_yields(wide, GROUP)


@query(
    sql=f"with {v.curve_samples(MANY, SPREAD)} select date, tenor, avg({v.curve_value('maturity')}) as mean_yield from samples cross join tenors group by date, tenor",
    doubles="mean_yield",
)
def e6_mean_curve(spark, sf):
    wide = curve.mean_yields(_samples(spark, sf, MANY), GROUP)
    return curve.to_long_yields(wide, ["date"], "mean_yield")


@query(sql=f"with {v.curve_samples(MANY, SPREAD)} select date, {MEANS} from samples group by date", doubles=TENOR_LIST)
def e7_mean_curves_wide(spark, sf):
    return curve.mean_yields(_samples(spark, sf, MANY), GROUP).drop("series_id")


def _results(spark, sf):
    """Long forecasts: a curve's coefficients as actual, one hundredth more as prediction."""
    items = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("actual"), (F.col(c) * 1.01).alias("prediction")) for c in COEFFICIENTS])
    return b.daily_curve(spark, sf).select(*GROUP, F.inline(items))


def _three_tables(spark, root, horizon):
    """All three yield tables, summed up by date and tenor."""
    ranked = tables.read_samples(spark, f"{root}/sample_yields", horizon).groupBy("date", "tenor").agg(
        F.count("*").alias("n_rows"), F.avg("yield_pct").alias("first"), F.sum(F.col("percentile") * F.col("yield_pct")).alias("second")
    )
    means = curve.to_long_yields(tables.read_samples(spark, f"{root}/mean_yields", horizon), ["date"], "first")
    point = tables.read_samples(spark, f"{root}/yield_results", horizon)
    pairs = [F.struct(F.lit(t).alias("tenor"), F.col(f"{t}_actual").alias("first"), F.col(f"{t}_prediction").alias("second")) for t in TENOR_NAMES]
    one, none = F.lit(1).cast("long").alias("n_rows"), F.lit(None).cast("double").alias("second")
    parts = {
        "sample_yields": ranked.select("date", "tenor", "n_rows", "first", "second"),
        "mean_yields": means.select("date", "tenor", one, "first", none),
        "yield_results": point.select("date", F.inline(F.array(*pairs))).select("date", "tenor", one, "first", "second"),
    }
    tagged = [df.select(F.lit(name).alias("stored"), "*") for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


THREE_TABLES = f"""with {v.curve_samples(DRAWS, SPREAD)}, {PERCENT}
 select 'sample_yields' as stored, date, tenor, count(*) as n_rows, avg(yield_pct) as first, sum(percentile*yield_pct) as second from ranked group by date, tenor
 union all select 'mean_yields', date, tenor, 1, avg(yield_pct), null from points group by date, tenor
 union all select 'yield_results', date, tenor, 1, {v.curve_value('maturity', 'v1.')},
  {v.curve_value('maturity', 'p.')} from v1 join (select date, {', '.join(f'{c}*1.01e0 as {c}' for c in COEFFICIENTS)} from v1) as p using (date) cross join tenors"""


@query(sql=THREE_TABLES, doubles="first second", digits=5)
def e8_stored_yield_tables(spark, sf):
    """Samples and forecasts stored, both transformed to yield tables on storage, all three read back."""
    root = tables.shared_folder(spark, "yields")
    tag = F.lit("one-day-ahead").alias("horizon")
    tables.write_table(_samples(spark, sf).select(tag, "*"), f"{root}/samples", ["horizon"])
    tables.write_table(_results(spark, sf).select(tag, "*"), f"{root}/results", ["horizon"])
    yields.transform_horizon(spark, root, "one-day-ahead", COEFFICIENTS, DRAWS)
    return _three_tables(spark, root, "one-day-ahead")


@query(sql=f"with {v.V1} select date, beta0, beta1, beta2, lambda_ from v1", doubles=COEFS, digits=6)
def e9_curve_fit(spark, sf):
    """The curves' own coefficients, found again from eleven points each."""
    points = curve.curve_points(b.daily_curve(spark, sf)).join(
        F.broadcast(spark.createDataFrame(list(TENORS), "tenor string, maturity double")), "tenor"
    )
    fitted = curve.fit_curves(points.select("date", "maturity", (F.col("yield_pct") / 100).alias("y")), ["date"])
    return fitted.select("date", *COEFFICIENTS)


@query(
    sql=f"""with {v.curve_samples(DRAWS, SPREAD)}, observed as (select date, tenor, {v.curve_value('maturity')} as actual from v1 cross join tenors),
 predicted as (select date, tenor, avg({v.curve_value('maturity')}) as prediction from samples cross join tenors group by date, tenor)
 select date, tenor, actual, prediction, actual - prediction as error from observed join predicted using (date, tenor)""",
    doubles="actual prediction error",
)
def e10_compare_curves(spark, sf):
    observed = b.daily_curve(spark, sf).select("date", *curve.yields_percent())
    predicted = curve.mean_yields(_samples(spark, sf), GROUP).drop("series_id")
    return curve.compare_curves(observed, predicted, ["date"])


@query(
    sql=f"with {v.curve_samples(DRAWS, SPREAD)} select date, count(*) as n_samples, avg(beta0) as mean_beta0 from samples group by date",
    doubles="mean_beta0",
)
def a8_sample_scan(spark, sf):
    """Two horizons stored, one read back through partition pruning."""
    root = tables.shared_folder(spark, "samples")
    both = F.array(F.lit("one-day-ahead"), F.lit("seven-day-ahead"))
    tagged = _samples(spark, sf).select(F.explode(both).alias("horizon"), "*")
    tables.write_table(tagged, root, ["horizon"])
    kept = tables.read_samples(spark, root, "seven-day-ahead")
    return kept.groupBy("date").agg(F.count("*").alias("n_samples"), F.avg("beta0").alias("mean_beta0"))


COEF_SQL = "count(*) as n_samples, " + ", ".join(f"avg({c}) as {c}, sum({c}*(sample_id + 1)) as {c}_by_id" for c in COEFFICIENTS)
COEF_DOUBLES = COEFS + " " + " ".join(f"{c}_by_id" for c in COEFFICIENTS)


def _coef_of():
    sums = [F.avg(c).alias(c) for c in COEFFICIENTS]
    sums += [F.sum(F.col(c) * (F.col("sample_id") + 1)).alias(f"{c}_by_id") for c in COEFFICIENTS]
    return [F.count("*").alias("n_samples"), *sums]


@query(sql=f"with {v.curve_samples(DRAWS, SPREAD)} select series_id, date, {COEF_SQL} from samples group by series_id, date", doubles=COEF_DOUBLES)
def a10_sample_sink(spark, sf):
    root = tables.shared_folder(spark, "sample-sink")
    month = F.date_format("date", "yyyy-MM").alias("month")
    tagged = _samples(spark, sf).select(F.lit("one-day-ahead").alias("horizon"), month, "*")
    tables.write_table(tagged, root, ["horizon", "month"])
    return tables.read_samples(spark, root, "one-day-ahead").groupBy(*GROUP).agg(*_coef_of())


@query(sql=THREE_TABLES, doubles="first second", digits=5)
def a12_yield_sinks(spark, sf):
    """Sample, mean and point yields written by horizon and read back."""
    root, tag = tables.shared_folder(spark, "yield-sinks"), F.lit("one-day-ahead").alias("horizon")
    drawn = tables.materialize(_samples(spark, sf), "draws")
    sums = [F.max(F.when(F.col("target") == c, F.col(p))).alias(f"{p}_{c}") for c in COEFFICIENTS for p in ("actual", "prediction")]
    wide = _results(spark, sf).groupBy(*GROUP).agg(*sums)
    for name, df in {
        "sample_yields": curve.sample_yields(drawn, GROUP, max_group=DRAWS),
        "mean_yields": curve.mean_yields(drawn, GROUP),
        "yield_results": curve.point_yields(wide, GROUP),
    }.items():
        tables.write_table(df.select(tag, "*"), f"{root}/{name}", ["horizon"])
    return _three_tables(spark, root, "one-day-ahead")


@query(sql=f"with {v.curve_samples(DRAWS, SPREAD)} select date, {COEF_SQL} from samples group by date", doubles=COEF_DOUBLES)
def g3_process_samples(spark, sf):
    return _samples(spark, sf).groupBy("date").agg(*_coef_of())


@query(sql=f"with {v.curve_samples(DRAWS, '0.01e0')} select date, {COEF_SQL} from samples group by date", doubles=COEF_DOUBLES)
def g4_fixed_scale_samples(spark, sf):
    return _samples(spark, sf, scale=SCALE).groupBy("date").agg(*_coef_of())


@query(sql=f"with {v.curve_samples(DRAWS, '0.01e0')} select date, {COEF_SQL} from samples group by date", doubles=COEF_DOUBLES)
def g5_sample_reshape(spark, sf):
    long = samples.samples_long(_samples(spark, sf, scale=SCALE), COEFFICIENTS, ["date"])
    return samples.samples_wide(long, COEFFICIENTS, ["date"]).groupBy("date").agg(*_coef_of())
