"""Forecast-evaluation metrics and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import bindings as b
from contract import views as v
from contract.registry import query
from curvewalk.functions import EXACT_KS
from curvewalk.operators import evaluate as ev
from curvewalk.operators import report
from curvewalk.sources import tables

KEYS = b.FORECAST_KEYS
VALID = "y_true is not null and y_pred is not null"


def _sequenced(spark, sf) -> DataFrame:
    rows = b.stored_forecasts(spark, sf)
    return ev.sequence_columns(rows, KEYS, b.FORECAST_ORDER, b.forecast_granules())


def _all(spark, sf) -> DataFrame:
    rows = b.stored_forecasts(spark, sf)
    return ev.all_metrics(rows, KEYS, b.FORECAST_ORDER, b.forecast_granules())


BASIC = """select segment, avg(abs(e)) as mae, avg(e*e) as mse, sqrt(avg(e*e)) as rmse,
 1e0 - sum(e*e)/(var_pop(y_true)*count(*)) as r2, count(*) as n_samples from ok4 group by segment"""
PERCENTAGE = """select segment, avg(abs(e/y_true))*100 as mape,
 avg(2*abs(e)/(abs(y_pred)+abs(y_true)))*100 as smape from ok4 where y_true <> 0 group by segment"""
STEPS = """steps as (select segment, y_true - lag(y_true) over w as dy, y_pred - lag(y_pred) over w as dp from v4
 window w as (partition by segment order by date, order_key))"""
DIRECTIONAL = """select segment, avg(case when (dy > 0) = (dp > 0) then 100e0 else 0e0 end) as directional_accuracy,
 avg(case when dy > 0 then case when dp > 0 then 100e0 else 0e0 end end) as up_accuracy,
 avg(case when not dy > 0 then case when dp > 0 then 0e0 else 100e0 end end) as down_accuracy,
 count(*) filter (where dy > 0) as n_up_movements, count(*) filter (where not dy > 0) as n_down_movements
 from steps where dy is not null and dp is not null group by segment"""
DISTRIBUTION = """select segment, avg(y_pred) - avg(y_true) as bias, (avg(y_pred) - avg(y_true))/avg(y_true) as relative_bias,
 avg(y_true) as true_mean, avg(y_pred) as pred_mean, stddev_pop(y_true) as true_std, stddev_pop(y_pred) as pred_std,
 stddev_pop(y_pred)/stddev_pop(y_true) as std_ratio from ok4 group by segment"""
UNCERTAINTY = """select segment,
 avg(case when y_true between y_pred - 1.96e0*y_std and y_pred + 1.96e0*y_std then 100e0 else 0e0 end) as coverage_95,
 avg(case when y_true between y_pred - y_std and y_pred + y_std then 100e0 else 0e0 end) as coverage_68,
 avg(2*1.96e0*y_std) as avg_interval_width_95, avg(2*y_std) as avg_interval_width_68, avg(y_std) as avg_prediction_std
 from ok4 where y_std is not null group by segment"""
MOMENTS = """centred as (select segment, e, e - avg(e) over (partition by segment) as c from ok4),
 moments as (select segment, count(*) as n, avg(c*c) as m2, avg(c*c*c) as m3, avg(c*c*c*c) as m4, avg(e) as mean, min(e) as lo,
  max(e) as hi from centred group by segment)"""
RESIDUAL = """select segment, mean as residual_mean, sqrt(m2) as residual_std, m3/power(m2, 1.5e0) as residual_skewness,
 m4/(m2*m2) - 3 as residual_kurtosis, lo as residual_min, hi as residual_max,
 n/6e0*(power(m3/power(m2, 1.5e0), 2) + power(m4/(m2*m2) - 3, 2)/4e0) as jarque_bera_statistic,
 exp(-n/12e0*(power(m3/power(m2, 1.5e0), 2) + power(m4/(m2*m2) - 3, 2)/4e0)) as jarque_bera_pvalue from moments"""
RESIDUAL_DOUBLES = "residual_mean residual_std residual_skewness residual_kurtosis residual_min residual_max jarque_bera_statistic jarque_bera_pvalue"
LAGGED = """lagged as (select segment, e, lag(e) over (partition by segment order by date, order_key) as p from ok4)"""
AUTOCORRELATION = "select segment, corr(e, p) as autocorr_lag1 from lagged where p is not null group by segment"
HALVES = """select segment, var_pop(case when vpos >= vtotal // 2 then e end)/var_pop(case when vpos < vtotal // 2 then e end) as variance_ratio
 from ok4 group by segment"""
#: Paths that leave the band, by binomial coefficients.
EXACT = """case when round(ks_statistic*n) = 0 then 1e0 else greatest(0e0, least(1e0, 2e0*(select sum((case when i % 2 = 1 then 1e0 else -1e0 end)
  *exp(2*lgamma(n + 1) - lgamma(n + i*round(ks_statistic*n) + 1) - lgamma(n - i*round(ks_statistic*n) + 1)))
  from range(1, 10001) as ks_i(i) where i*round(ks_statistic*n) <= n))) end"""
KS = f"""both_sides as (select segment, y_true as x, 1 as a, 0 as b from ok4 union all select segment, y_pred, 0, 1 from ok4),
 steps_up as (select segment, x, sum(a) as a, sum(b) as b from both_sides group by segment, x),
 gaps as (select segment, abs(sum(a) over (partition by segment order by x)/(sum(a) over (partition by segment))::double
   - sum(b) over (partition by segment order by x)/(sum(b) over (partition by segment))::double) as gap,
   (sum(a) over (partition by segment))::double as n from steps_up),
 ks_d as (select segment, max(gap) as ks_statistic, max(n) as n from gaps group by segment),
 ks_terms as (select segment, n, ks_statistic, ks_statistic*sqrt(n*n/(n+n)) as lam from ks_d),
 ks as (select segment, ks_statistic, case when n <= {EXACT_KS} then {EXACT} when lam < 0.2e0 then 1e0 else greatest(0e0, least(1e0,
   2e0*(select sum((case when k % 2 = 1 then 1e0 else -1e0 end)*exp(-2e0*k*k*lam*lam)) from range(1, 101) as ks_k(k)))) end as ks_pvalue from ks_terms)"""
FRANCIA = f"""places as (select segment, e, row_number() over (partition by segment order by e) as i, count(*) over (partition by segment) as n from ok4),
 scored as (select segment, e, {v.normal_quantile('(i - 0.375e0)/(n + 0.25e0)')} as m from places),
 francia as (select segment, power(covar_pop(e, m), 2)/(var_pop(e)*var_pop(m)) as shapiro_francia_w, count(*) as n from scored group by segment),
 judged as (select *, (ln(1e0 - shapiro_francia_w) + 1.2725e0 - 1.0521e0*(ln(ln(n)) - ln(n)))/(1.0308e0 - 0.26758e0*(ln(ln(n)) + 2e0/ln(n))) as z from francia),
 normality as (select segment, shapiro_francia_w, {v.normal_upper('z')} as shapiro_francia_p from judged)"""


@query(sql=f"with {v.V4} select segment, count(*) as n_rows, sum(y_pred) as sum_pred from v4 where {VALID} group by segment", doubles="sum_pred", digits=4)
def b7_pairwise_mask(spark, sf):
    kept = ev.prepare(b.forecasts(spark, sf)).filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return kept.groupBy("segment").agg(F.count("*").alias("n_rows"), F.sum("y_pred").alias("sum_pred"))


@query(sql="select segment, order_key, y from (select c_mktsegment as segment, o_orderkey as order_key, case when o_orderstatus = 'P' then 0e0 else o_totalprice/1e5 end as y from orders join customer on o_custkey = c_custkey) as priced where y is not null and y <> 0", doubles="y")
def b8_non_zero_mask(spark, sf):
    joined = b.table(spark, sf, "orders").join(b.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice") / 1e5)
    rows = joined.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderkey").alias("order_key"), price.alias("y"))
    return rows.filter(F.col("y").isNotNull() & (F.col("y") != 0))


@query(sql=f"with {v.V4} select segment, date, order_key, y_true, y_pred, y_std from v4 where {VALID} and y_std is not null", doubles="y_true y_pred y_std")
def b9_three_way_mask(spark, sf):
    rows = ev.prepare(b.forecasts(spark, sf)).na.drop(subset=["y_true", "y_pred", "y_std"])
    return rows.select("segment", "date", "order_key", "y_true", "y_pred", "y_std")


@query(sql=f"with {v.V4} {BASIC}", doubles="mae mse rmse r2")
def h1_basic(spark, sf):
    return ev.metrics(ev.prepare(b.forecasts(spark, sf)), KEYS, ev.basic_columns())


@query(sql=f"with {v.V4} {PERCENTAGE}", doubles="mape smape", digits=4)
def h2_percentage(spark, sf):
    return ev.metrics(ev.prepare(b.forecasts(spark, sf)), KEYS, ev.percentage_columns())


@query(sql=f"with {v.V4}, {STEPS} {DIRECTIONAL}", doubles="directional_accuracy up_accuracy down_accuracy")
def h3_directional(spark, sf):
    return ev.metrics(_sequenced(spark, sf), KEYS, ev.directional_columns())


@query(sql=f"with {v.V4} {DISTRIBUTION}", doubles="bias relative_bias true_mean pred_mean true_std pred_std std_ratio")
def h4_distribution(spark, sf):
    return ev.metrics(ev.prepare(b.forecasts(spark, sf)), KEYS, ev.distribution_columns())


@query(sql=f"with {v.V4}, {KS} select segment, ks_statistic, ks_pvalue from ks", doubles="ks_statistic ks_pvalue")
def h5_ks_two_sample(spark, sf):
    return ev.ks_two_sample(b.stored_forecasts(spark, sf), KEYS)


@query(sql=f"with {v.V4} {UNCERTAINTY}", doubles="coverage_95 coverage_68 avg_interval_width_95 avg_interval_width_68 avg_prediction_std")
def h6_uncertainty(spark, sf):
    return ev.metrics(ev.prepare(b.forecasts(spark, sf)), KEYS, ev.uncertainty_columns())


@query(sql=f"with {v.V4}, {MOMENTS} {RESIDUAL}", doubles=RESIDUAL_DOUBLES)
def h7_residual_moments(spark, sf):
    return ev.metrics(ev.prepare(b.forecasts(spark, sf)), KEYS, ev.residual_columns())


@query(sql=f"with {v.V4}, {LAGGED} {AUTOCORRELATION}", doubles="autocorr_lag1")
def h8_autocorrelation(spark, sf):
    return ev.metrics(_sequenced(spark, sf), KEYS, ev.autocorrelation_columns())


@query(sql=f"with {v.V4} {HALVES}", doubles="variance_ratio")
def h9_variance_ratio(spark, sf):
    return ev.metrics(_sequenced(spark, sf), KEYS, ev.variance_ratio_columns())


@query(sql=f"with {v.V4}, {FRANCIA} select * from normality", doubles="shapiro_francia_w shapiro_francia_p", digits=9)
def h10_normality(spark, sf):
    return ev.shapiro_francia(b.stored_forecasts(spark, sf), KEYS)


H11 = f"""with {v.V4}, {STEPS}, {MOMENTS}, {LAGGED}, {KS}, {FRANCIA}
 select * from ({BASIC}) as g1 join ({PERCENTAGE}) as g2 using (segment) join ({DIRECTIONAL}) as g3 using (segment)
 join ({DISTRIBUTION}) as g4 using (segment) join ({UNCERTAINTY}) as g5 using (segment) join ({RESIDUAL}) as g6 using (segment)
 join ({AUTOCORRELATION}) as g7 using (segment) join ({HALVES}) as g8 using (segment) join ks using (segment) join normality using (segment)"""
GROUPS = ("basic", "percentage", "directional", "distribution", "uncertainty", "residual")
H11_DOUBLES = (
    "mae mse rmse r2 mape smape directional_accuracy up_accuracy down_accuracy bias relative_bias true_mean pred_mean true_std "
    "pred_std std_ratio coverage_95 coverage_68 avg_interval_width_95 avg_interval_width_68 avg_prediction_std "
    f"{RESIDUAL_DOUBLES} autocorr_lag1 variance_ratio ks_statistic ks_pvalue shapiro_francia_w shapiro_francia_p"
)


@query(sql=H11, doubles=H11_DOUBLES, digits=4)
def h11_all_metrics(spark, sf):
    return _all(spark, sf).select("segment", *[f"{g}.*" for g in GROUPS])


_SUMMARY = {
    "MAE": "mae", "RMSE": "rmse", "R²": "r2", "MAPE (%)": "mape",
    "Directional Accuracy (%)": "directional_accuracy", "Coverage 95% (%)": "coverage_95", "Bias": "bias",
}


@query(
    sql=f"with whole as ({H11}) " + " union all ".join(f"select segment, '{k}' as metric, {c} as value from whole" for k, c in _SUMMARY.items()),
    doubles="value",
    digits=4,
)
def h12_metrics_summary(spark, sf):
    return ev.metrics_summary(_all(spark, sf), KEYS)


_COMPARED = "mae rmse r2 mape directional_accuracy coverage_95"
COMPARISON = f"select segment, {', '.join(_COMPARED.split())} from ({H11}) as whole"


def _comparison(spark, sf) -> DataFrame:
    rows = b.stored_forecasts(spark, sf)
    return ev.compare_models(rows, KEYS, b.FORECAST_ORDER, b.forecast_granules())


@query(sql=COMPARISON, doubles=_COMPARED, digits=4)
def h13_compare_models(spark, sf):
    return _comparison(spark, sf)


@query(
    sql=f"""with {v.V4}, daily as (select segment, date, count(*) as n, avg(e) as mean, stddev_pop(e) as std,
  avg(y_pred) - avg(y_true) as shift from ok4 group by segment, date),
 days as (select distinct segment, date from v4)
 select days.segment, days.date, case when n >= 3 then shift end as bias, case when n >= 3 then mean end as residual_mean,
  case when n >= 3 then std end as residual_std, coalesce(n, 0) as n_samples
 from days left join daily on daily.segment = days.segment and daily.date = days.date""",
    doubles="bias residual_mean residual_std",
)
def h14_small_groups(spark, sf):
    """Per segment and day, where most groups are too small for distribution metrics."""
    daily = ev.metrics(
        ev.prepare(b.forecasts(spark, sf)),
        ["segment", "date"],
        ev.basic_columns(),
        ev.distribution_columns(),
        ev.residual_columns(),
    )
    return daily.select("segment", "date", "bias", "residual_mean", "residual_std", "n_samples")


@query(sql=f"select segment, mae, ks_statistic, autocorr_lag1, n_up_movements from ({H11}) as whole", doubles="mae ks_statistic autocorr_lag1")
def a13_metrics_json(spark, sf):
    """Metrics written as JSON files and read back."""
    path = tables.shared_folder(spark, "metrics-json")
    tables.write_metrics_json(_all(spark, sf), path)
    shape = (
        "segment string, basic struct<mae: double>, distribution struct<ks_statistic: double>, "
        "residual struct<autocorr_lag1: double>, directional struct<n_up_movements: bigint>"
    )
    back = spark.read.schema(shape).json(path)
    return back.select(
        "segment", "basic.mae", "distribution.ks_statistic", "residual.autocorr_lag1", "directional.n_up_movements"
    )


@query(sql=f"select segment, mae, coverage_95 from ({H11}) as whole", doubles="mae coverage_95")
def a13_metrics_json_text(spark, sf):
    text = ev.metrics_json(_all(spark, sf), KEYS)
    picked = F.from_json("metrics_json", "basic struct<mae: double>, uncertainty struct<coverage_95: double>")
    return text.select("segment", picked.alias("m")).select("segment", "m.basic.mae", "m.uncertainty.coverage_95")


@query(sql=f"with {v.V4} select segment, order_key, y_true, y_pred, y_pred - 1.96e0*y_std as lower, y_pred + 1.96e0*y_std as upper from v4", doubles="y_true y_pred lower upper")
def i1_forecast_band(spark, sf):
    return report.forecast_band(b.forecasts(spark, sf), ["segment", "order_key"])


@query(
    sql=f"with {v.V4}, x as (select segment, date, order_key, abs(y_true - y_pred) as abs_error from v4) select segment, order_key, case when count(abs_error) over w = 30 then avg(abs_error) over w end as rolling_abs_error from x window w as (partition by segment order by date, order_key rows between 29 preceding and current row)",
    doubles="rolling_abs_error",
)
def i2_rolling_metric(spark, sf):
    rows = b.forecasts(spark, sf).withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    return report.rolling_mean(rows, KEYS, "abs_error", 30).select("segment", "order_key", "rolling_abs_error")


@query(sql=f"with {v.V4} select segment, pos as time_index, y_pred as fitted, y_true - y_pred as residual from v4", doubles="fitted residual")
def i3_residual_table(spark, sf):
    return report.residual_table(b.forecasts(spark, sf), ["segment"])


@query(
    sql=f"""with {v.V4}, ends as (select segment, min(e) as lo, max(e) as hi, count(*) as n from ok4 group by segment),
 binned as (select ok4.segment, least(29, floor((e - lo)/((hi - lo)/30)))::int as bin, count(*) as rows from ok4 join ends on ok4.segment = ends.segment group by all),
 bins as (select ends.*, unnest(range(30))::int as bin from ends)
 select bins.segment, bins.bin, lo + bins.bin*((hi - lo)/30) as bin_start, coalesce(rows, 0) as rows, coalesce(rows, 0)/(n*((hi - lo)/30)) as density
  from bins left join binned on bins.segment = binned.segment and bins.bin = binned.bin""",
    doubles="bin_start density",
)
def i4_residual_histogram(spark, sf):
    return report.residual_histogram(b.stored_forecasts(spark, sf), KEYS)


_FILLIBEN = "case when i = n then power(0.5e0, 1e0/n) when i = 1 then 1e0 - power(0.5e0, 1e0/n) else (i - 0.3175e0)/(n + 0.365e0) end"
QQ = f"""places as (select segment, e, row_number() over (partition by segment order by e) as i, count(*) over (partition by segment) as n from ok4),
 spots as (select segment, e, i, {_FILLIBEN} as p from places),
 qq as (select segment, i as ordinal, {v.normal_quantile('p')} as quantile, e as residual from spots)"""


@query(sql=f"with {v.V4}, {QQ} select * from qq", doubles="quantile residual")
def i5_normal_qq(spark, sf):
    return report.normal_qq(b.stored_forecasts(spark, sf), KEYS)


@query(
    sql=f"with {v.V4}, {QQ} select segment, regr_slope(residual, quantile) as slope, regr_intercept(residual, quantile) as intercept, corr(residual, quantile) as r from qq group by segment",
    doubles="slope intercept r",
)
def i5_qq_line(spark, sf):
    return report.qq_line(report.normal_qq(b.stored_forecasts(spark, sf), KEYS), KEYS)


@query(
    sql=f"with whole as ({H11}) " + " union all ".join(f"select segment, '{k}' as metric, {c} as value from whole" for k, c in (("MAE", "mae"), ("RMSE", "rmse"), ("MAPE", "mape"), ("Directional_Accuracy", "directional_accuracy"))),
    doubles="value",
    digits=4,
)
def i6_metric_matrix(spark, sf):
    return report.metric_matrix(_comparison(spark, sf), KEYS)


# The driver's customer segments.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_MATRIX = ", ".join(f"max(case when segment = '{x}' then value end) as \"{x}\"" for x in SEGMENTS)


@query(
    sql=f"with whole as ({H11}), long as (" + " union all ".join(f"select segment, '{k}' as metric, {c} as value from whole" for k, c in (("MAE", "mae"), ("RMSE", "rmse"), ("MAPE", "mape"), ("Directional_Accuracy", "directional_accuracy"))) + f") select metric, {_MATRIX} from long group by metric",
    doubles=" ".join(SEGMENTS),
    digits=4,
)
def i6_matrix_form(spark, sf):
    """A row for each metric, a column for each segment."""
    return report.metric_matrix(_comparison(spark, sf), KEYS, "segment", SEGMENTS)


def _summary(spark, sf) -> DataFrame:
    rows = b.stored_forecasts(spark, sf)
    sizes = ev.metrics(ev.prepare(rows), KEYS, ev.basic_columns())
    compared = ev.compare_models(rows, KEYS, b.FORECAST_ORDER, b.forecast_granules())
    results = compared.join(sizes.select("segment", F.col("n_samples").alias("predictions_count")), "segment")
    return report.summary_report(results, "segment")


REPORT = f"""select segment as "Bond_Index", mae as "MAE", rmse as "RMSE", mape as "MAPE", directional_accuracy as "Directional_Accuracy",
 'Unknown' as "Best_Kernel", cast(null as double) as "Training_Time", n_samples as "Predictions_Count" from ({H11}) as whole"""


@query(sql=REPORT, doubles="MAE RMSE MAPE Directional_Accuracy Training_Time", digits=4)
def i8_summary_report(spark, sf):
    return _summary(spark, sf)


@query(sql=REPORT, doubles="MAE RMSE MAPE Directional_Accuracy Training_Time", digits=4)
def a14_report_csv(spark, sf):
    path = tables.shared_folder(spark, "report-csv")
    made = _summary(spark, sf)
    tables.write_report_csv(made, path)
    return spark.read.option("header", True).schema(made.schema).csv(path)
