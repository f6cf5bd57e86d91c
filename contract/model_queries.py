"""Candidate grids, fits, scores, selection, prediction and whole backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contract import bindings as b
from contract import views as v
from contract.panel_queries import CONFIG
from contract.registry import query
from curvewalk.operators import candidates, gaussian, report, ridge, scores
from curvewalk.operators.candidates import KERNELS, KernelGrid, PRIORS
from curvewalk.operators.folds import WalkForward, prediction_rows
from curvewalk.plans.backtest import Backtest, continue_backtest, forecast_horizon, gaussian_backtest, ridge_backtest
from curvewalk.sources import tables

KEYS = ["series_id", "fold"]
FEATURES, TARGETS = b.FEATURES, b.TARGETS
INDUCING = b.PLAN.window


def _folds(spark, sf) -> DataFrame:
    return prediction_rows(b.panel(spark, sf), b.PLAN).filter("retrain").select(*KEYS)


def _fixed_fits(panel: DataFrame) -> DataFrame:
    grams = ridge.fold_grams(panel, b.PLAN, FEATURES, TARGETS)
    return ridge.fixed_ridge(grams, v.PENALTIES, len(FEATURES), len(TARGETS))


def _fits(panel: DataFrame) -> DataFrame:
    """Six priors, all features and targets."""
    grams = ridge.fold_grams(panel, b.PLAN, FEATURES, TARGETS)
    return ridge.evidence_ridge(grams, len(FEATURES), len(TARGETS))


def _scores(spark, sf) -> DataFrame:
    panel = b.panel(spark, sf)
    return ridge.training_scores(panel, b.PLAN, _fits(panel), FEATURES, TARGETS)


def _best_fits(panel: DataFrame) -> DataFrame:
    fits = _fits(panel)
    scored = ridge.training_scores(panel, b.PLAN, fits, FEATURES, TARGETS)
    best = scores.best_candidates(scored, KEYS, "r2_avg")
    return fits.join(best.select(*KEYS, "candidate"), [*KEYS, "candidate"])


_KERNEL_ROWS = ", ".join(f"('{k}', {i}, {len(KernelGrid().shapes(k))})" for i, k in enumerate(KERNELS))


@query(sql=f"with {v.FOLDS}, grid(candidate, ordinal, n_shapes) as (values {_KERNEL_ROWS}) select series_id, fold, candidate, ordinal, n_shapes from folds cross join grid")
def f1_kernel_grid(spark, sf):
    shaped = candidates.with_candidates(_folds(spark, sf), candidates.kernel_grid())
    return shaped.groupBy(*KEYS, "candidate", "ordinal").agg(F.count("*").alias("n_shapes"))


_PRIOR_ROWS = ", ".join(f"('{k}', {i}, {a!r}::double)" for i, (k, a) in enumerate(PRIORS.items()))


@query(sql=f"with {v.FOLDS}, grid(candidate, ordinal, alpha) as (values {_PRIOR_ROWS}) select series_id, fold, candidate, ordinal, alpha from folds cross join grid", doubles="alpha")
def f2_prior_grid(spark, sf):
    rows = candidates.with_candidates(_folds(spark, sf), candidates.prior_grid())
    return rows.select(*KEYS, "candidate", "ordinal", F.col("params")["alpha"].alias("alpha"))


_OFFSETS = ", ".join(f"({o})" for o in gaussian.inducing_positions(b.PLAN.window, INDUCING))
_D2 = " + ".join(f"(train.{x} - centre.{x})*(train.{x} - centre.{x})" for x in FEATURES)


@query(
    sql=f"""with {v.TRAIN}, placed as (select train.*, train.pos - (fit_end - {v._W}) as offset_in from train join folds using (series_id, fold)),
 offsets(o) as (values {_OFFSETS}),
 pairs as (select train.series_id, train.fold, centre.offset_in as inducing_offset, {_D2} as d2 from placed as train
  join (select placed.* from placed join offsets on offset_in = o) as centre on train.series_id = centre.series_id and train.fold = centre.fold)
 select series_id, fold, inducing_offset, count(*) as n_rows, avg(exp(-d2/0.02e0)) as rbf, avg(power(1 + d2/0.02e0, -1)) as rational_quadratic,
  avg(exp(-2*power(sin(sqrt(d2)*pi()/5e0)/0.1e0, 2))) as exp_sine_squared from pairs group by series_id, fold, inducing_offset""",
    doubles="rbf rational_quadratic exp_sine_squared",
)
def f4_kernel_table(spark, sf):
    rows = gaussian.kernel_rows(b.panel(spark, sf), b.PLAN, FEATURES, INDUCING)
    d2 = F.col("squared")
    rows = rows.withColumns(
        {
            "rbf": gaussian.kernel_values("RBF", d2, length=0.1),
            "rational_quadratic": gaussian.kernel_values("RationalQuadratic", d2, length=0.1, mixture=1.0),
            "exp_sine_squared": gaussian.kernel_values("ExpSineSquared", d2, length=0.1, period=5.0),
        }
    )
    return rows.groupBy(*KEYS, "inducing_offset").agg(
        F.count("*").alias("n_rows"),
        F.avg("rbf").alias("rbf"),
        F.avg("rational_quadratic").alias("rational_quadratic"),
        F.avg("exp_sine_squared").alias("exp_sine_squared"),
    )


def _gaussian(spark, sf, plan=b.PLAN) -> Backtest:
    return gaussian_backtest(b.panel(spark, sf), plan, b.FEATURES, TARGETS)


def _ridge(spark, sf, plan=b.PLAN) -> Backtest:
    return ridge_backtest(b.panel(spark, sf), plan, b.FEATURES, TARGETS)


@query()
def f5_gaussian_fit(spark, sf):
    return _gaussian(spark, sf).scores.select(*KEYS, "candidate", "n_train", "cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat")


_Z = ["1e0", *FEATURES, *TARGETS]
_PAIRS = ridge.gram_names(len(_Z))
_GRAM = ", ".join(f"sum({_Z[i]}*{_Z[j]}) as s{i}_{j}" for i, j in _PAIRS)
_GRAM_NAMES = " ".join(f"s{i}_{j}" for i, j in _PAIRS)


@query(sql=f"with {v.TRAIN} select series_id, fold, {_GRAM} from train group by series_id, fold", doubles=_GRAM_NAMES)
def f6_fold_gram(spark, sf):
    grams = ridge.fold_grams(b.panel(spark, sf), b.PLAN, FEATURES, TARGETS, shift=False)
    return grams.select(*KEYS, *[F.col("gram")[p].alias(f"s{i}_{j}") for p, (i, j) in enumerate(_PAIRS)])


_WEIGHTS = [f"w{i}_{t}" for t in TARGETS for i in range(1 + len(FEATURES))]


def _weights(fits: DataFrame) -> list[Column]:
    columns = []
    for j, t in enumerate(TARGETS):
        columns.append(F.col("intercept")[j].alias(f"w0_{t}"))
        columns += [F.col("coef")[j][i].alias(f"w{i + 1}_{t}") for i in range(len(FEATURES))]
    return columns


@query(sql=f"with {v.FIXED_FITS} select series_id, fold, candidate, {', '.join(_WEIGHTS)} from fits", doubles=" ".join(_WEIGHTS))
def f6_fixed_ridge(spark, sf):
    fits = _fixed_fits(b.panel(spark, sf))
    return fits.select(*KEYS, "candidate", *_weights(fits))


@query(
    sql=f"with recursive {v.EVIDENCE_FITS} select series_id, fold, candidate, n as n_train, {', '.join(_WEIGHTS)} from fits",
    doubles=" ".join(_WEIGHTS),
)
def f6_evidence_ridge(spark, sf):
    """Six priors, seven features, four targets, by the same iteration as the SQL's recursion."""
    panel = b.panel(spark, sf)
    fits = _fits(panel)
    return fits.select(*KEYS, "candidate", "n_train", *_weights(fits))


@query(sql=f"with {v.TRAIN} select series_id, fold, 3 as n_candidates, '{', '.join(sorted(KERNELS))}' as candidates, count(*) as n_train from train group by series_id, fold")
def f7_gaussian_candidates(spark, sf):
    """Every fold is fitted with every kernel on its whole window."""
    return _gaussian(spark, sf).scores.groupBy(*KEYS).agg(
        F.count("*").alias("n_candidates"),
        F.array_join(F.array_sort(F.collect_list("candidate")), ", ").alias("candidates"),
        F.max("n_train").alias("n_train"),
    )


@query(
    sql=f"with recursive {v.scores(v.EVIDENCE_FITS)} select * from scores",
    doubles="cosine_similarity euclidean_rmse r2_avg r2_flat",
)
def f8_ridge_candidates(spark, sf):
    return _ridge(spark, sf).scores


_GUESSES = [f"prediction_{t}" for t in TARGETS]


@query(sql=f"with recursive {v.in_sample(v.EVIDENCE_FITS)} select series_id, fold, candidate, pos, {', '.join(_GUESSES)} from fitted", doubles=" ".join(_GUESSES))
def f9_in_sample(spark, sf):
    panel = b.panel(spark, sf)
    fitted = ridge.in_sample(panel, b.PLAN, _fits(panel), FEATURES, TARGETS)
    return fitted.select(*KEYS, "candidate", "pos", *_GUESSES)


@query(sql=f"with {v.V6} select label, avg(xy/(sqrt(xx)*sqrt(yy))) as cosine_similarity from v6 group by label", doubles="cosine_similarity")
def f10_cosine(spark, sf):
    return scores.vector_scores(b.vectors(spark, sf), ["label"]).select("label", "cosine_similarity")


@query(sql=f"with {v.V6} select label, sqrt(avg(gap)) as euclidean_rmse from v6 group by label", doubles="euclidean_rmse")
def f11_euclidean_rmse(spark, sf):
    return scores.vector_scores(b.vectors(spark, sf), ["label"]).select("label", "euclidean_rmse")


@query(sql=f"with recursive {v.scores(v.EVIDENCE_FITS)} select series_id, fold, candidate, r2_avg from scores", doubles="r2_avg")
def f12_r2_average(spark, sf):
    return _scores(spark, sf).select(*KEYS, "candidate", "r2_avg")


@query(sql=f"with recursive {v.scores(v.EVIDENCE_FITS)} select series_id, fold, candidate, r2_flat from scores", doubles="r2_flat")
def f13_r2_flat(spark, sf):
    return _scores(spark, sf).select(*KEYS, "candidate", "r2_flat")


@query(sql=f"with recursive {v.scores(v.EVIDENCE_FITS)} select * from scores", doubles="cosine_similarity euclidean_rmse r2_avg r2_flat")
def f13_all_scores(spark, sf):
    return _scores(spark, sf)


@query()
def f14_log_marginal_likelihood(spark, sf):
    return _gaussian(spark, sf).scores.select(*KEYS, "candidate", "params", "log_marginal_likelihood")


@query(sql=f"with recursive {v.best(v.EVIDENCE_FITS, 'r2_avg')} select series_id, fold, candidate, r2_avg, cosine_similarity from best", doubles="r2_avg cosine_similarity")
def f15_best_candidate(spark, sf):
    best = scores.best_candidates(_scores(spark, sf), KEYS, "r2_avg")
    return best.select(*KEYS, "candidate", "r2_avg", "cosine_similarity")


@query(
    sql=f"with {v.FOLDS} select series_id, fold, {len(FEATURES)} as n_features, 1e0 as whole from folds",
    doubles="whole",
)
def f17_process_relevance(spark, sf):
    """Inverse lengths of a process with one length for each feature: how many there are, and that they share 1."""
    run = gaussian_backtest(b.panel(spark, sf), b.PLAN, FEATURES, TARGETS, kernels=("RBF_ARD",), grid=KernelGrid(restarts=1))
    return run.importance().groupBy(*KEYS).agg(
        F.countDistinct("feature").alias("n_features"), F.sum(F.when(F.col("importance") > 0, F.col("importance"))).alias("whole")
    )


_FITTED = ", ".join(f"('{k}')" for k in KERNELS)


@query(
    sql=f"with {v.FOLDS}, kernels(candidate) as (values {_FITTED}) select series_id, fold, candidate, 0e0 as residual, 0e0 as evidence_gap, 0e0 as mean_gap, 0e0 as std_gap, true as inside from folds cross join kernels",
    doubles="residual evidence_gap mean_gap std_gap",
    digits=5,
)
def f5_process_identities(spark, sf):
    """Searched processes of all folds and kernels against plain solves at their hyper-parameters: every gap is 0."""
    panel = b.panel(spark, sf)
    fits = tables.materialize(gaussian.fit_predict(panel, b.PLAN, FEATURES, TARGETS), "process-fits")
    return gaussian.identities(panel, b.PLAN, fits, FEATURES, TARGETS)


def _narrow(spark, sf) -> Backtest:
    """The whole backtest on processes with given hyper-parameters and windows that SQL can follow."""
    return gaussian_backtest(b.panel(spark, sf), b.NARROW, FEATURES, TARGETS, grid=b.ONE)


@query(
    sql=f"with {v.PROCESS_SCORES} select * from scores",
    doubles="cosine_similarity euclidean_rmse r2_avg r2_flat",
)
def f5_fixed_process(spark, sf):
    found = _narrow(spark, sf).scores
    return found.select(*KEYS, "candidate", "ordinal", "n_train", "cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat")


@query(sql=f"with {v.PROCESS_SCORES} select series_id, fold, candidate, log_marginal_likelihood from process", doubles="log_marginal_likelihood")
def f14_fixed_evidence(spark, sf):
    return _narrow(spark, sf).scores.select(*KEYS, "candidate", "log_marginal_likelihood")


@query(sql=f"with {v.PROCESS_LONG} select * from long", doubles="actual prediction prediction_std")
def g1_fixed_predictions(spark, sf):
    return _narrow(spark, sf).long()


@query(
    sql=f"with recursive {v.best(v.EVIDENCE_FITS, 'cosine_similarity')} select s.series_id, s.fold, b.candidate as best_candidate, b.n_train, {len(FEATURES)} as n_features, 6 as n_candidates, s.candidate, s.cosine_similarity, s.euclidean_rmse, s.r2_avg, s.r2_flat from scores s join best b using (series_id, fold)",
    doubles="cosine_similarity euclidean_rmse r2_avg r2_flat",
)
def f16_ridge_summary(spark, sf):
    """Winners and the scores of all candidates."""
    summary = _ridge(spark, sf).summary()
    rows = summary.withColumn("n_candidates", F.size("available_candidates").cast("long")).withColumn("s", F.explode("candidate_scores"))
    each = ["candidate", "cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat"]
    return rows.select(*KEYS, "best_candidate", "n_train", "n_features", "n_candidates", *[f"s.{c}" for c in each])


@query()
def f16_model_summary(spark, sf):
    return _gaussian(spark, sf).summary()


def _importance(fits: str) -> str:
    sizes = [f"({' + '.join(f'abs(w{i}_{t})' for t in TARGETS)})/{len(TARGETS)}" for i in range(1, 1 + len(FEATURES))]
    each = " union all ".join(f"select series_id, fold, candidate, '{x}' as feature, {size} as size from fits" for x, size in zip(FEATURES, sizes))
    return f"{fits}, sizes as ({each}), importance as (select series_id, fold, candidate, feature, size/sum(size) over (partition by series_id, fold, candidate) as importance from sizes)"


@query(sql=f"with recursive {_importance(v.EVIDENCE_FITS)} select * from importance", doubles="importance")
def f17_feature_importance(spark, sf):
    panel = b.panel(spark, sf)
    fits = _fits(panel)
    return ridge.coefficient_importance(fits, [*KEYS, "candidate"], FEATURES)


@query(
    sql=f"with recursive {_importance(v.EVIDENCE_FITS)} select series_id, fold, candidate, feature, importance, place::int as rank from (select *, row_number() over (partition by series_id, fold, candidate order by importance desc, feature) as place from importance) as placed where place <= 5",
    doubles="importance",
)
def f18_top_features(spark, sf):
    ranked = ridge.coefficient_importance(_fits(b.panel(spark, sf)), [*KEYS, "candidate"], FEATURES)
    return scores.top_features(ranked, [*KEYS, "candidate"], 5)


@query(
    sql=f"with recursive {v.spread('r2_avg')} select series_id, fold, candidate, pos, {', '.join(_GUESSES)}, "
    + ", ".join(f"max(case when t = {j} then std end) as std_{t}" for j, t in enumerate(TARGETS))
    + " from predicted join spreads using (series_id, fold, pos) group by all",
    doubles=" ".join([*_GUESSES, *[f"std_{t}" for t in TARGETS]]),
)
def g2_ridge_predict(spark, sf):
    panel = b.panel(spark, sf)
    predicted = ridge.predict(panel, b.PLAN, _best_fits(panel), FEATURES, TARGETS)
    return predicted.select(*KEYS, "candidate", "pos", *_GUESSES, *[f"std_{t}" for t in TARGETS])


@query()
def g1_gaussian_predict(spark, sf):
    return _gaussian(spark, sf).long()


@query(sql=f"with recursive {v.scores(v.EVIDENCE_FITS)} select series_id, fold, candidate, r2_flat, r2_flat/sum(r2_flat) over (partition by series_id, fold) as share from scores", doubles="r2_flat share")
def i7_score_share(spark, sf):
    return report.score_share(_scores(spark, sf), KEYS, "r2_flat")


def _fixed(spark, sf) -> Backtest:
    """The whole backtest on ridge fits with given penalties, which SQL can follow."""

    def fit(grams: DataFrame) -> DataFrame:
        return ridge.fixed_ridge(grams, v.PENALTIES, len(FEATURES), len(TARGETS))

    return ridge_backtest(b.panel(spark, sf), b.PLAN, FEATURES, TARGETS, "r2_avg", std_mode="row_spread", fit=fit)


_SCHEDULE = f"pos - {v._W} as k, fold, (pos - {v._W}) % {v._R} = 0 as retrain"
_FIXED_LONG = f"{v.AHEAD}, long as (" + " union all ".join(
    f"select series_id, date, {_SCHEDULE}, candidate as best_candidate, '{t}' as target, actual_{t} as actual,"
    f" prediction_{t} as prediction, 0e0 as prediction_std from predicted"
    for t in TARGETS
) + ")"
_EVIDENCE_LONG = f"{v.spread()}, long as (" + " union all ".join(
    f"select series_id, date, {_SCHEDULE}, candidate as best_candidate, '{t}' as target, actual_{t} as actual,"
    f" prediction_{t} as prediction, std as prediction_std from predicted join spreads using (series_id, fold, pos) where t = {j}"
    for j, t in enumerate(TARGETS)
) + ")"


@query(sql=f"with recursive {_EVIDENCE_LONG} select * from long", doubles="actual prediction prediction_std")
def g6_result_rows(spark, sf):
    return _ridge(spark, sf).long()


_WIDE = ", ".join(
    f"max(actual_{t}) as actual_{t}, max(prediction_{t}) as prediction_{t}, max(case when t = {j} then std end) as std_{t}"
    for j, t in enumerate(TARGETS)
)
_WIDE_NAMES = " ".join(f"actual_{t} prediction_{t} std_{t}" for t in TARGETS)


@query(
    sql=f"with recursive {v.spread()} select series_id, date, pos, {_SCHEDULE}, candidate, {_WIDE} from predicted join spreads using (series_id, fold, pos) group by all",
    doubles=_WIDE_NAMES,
)
def c7_backtest(spark, sf):
    return _ridge(spark, sf).forecasts


@query(
    sql=f"with {v.AHEAD} select series_id, date, pos, {_SCHEDULE}, candidate, {', '.join(f'actual_{t}, prediction_{t}, 0e0 as std_{t}' for t in TARGETS)} from predicted",
    doubles=" ".join(f"actual_{t} prediction_{t} std_{t}" for t in TARGETS),
)
def c7_fixed_backtest(spark, sf):
    return _fixed(spark, sf).forecasts


@query(sql=f"with {_FIXED_LONG} select * from long", doubles="actual prediction prediction_std")
def g6_fixed_result_rows(spark, sf):
    return _fixed(spark, sf).long()


@query(sql=f"with {v.SCORES} select series_id, fold, candidate, ordinal, r2_avg from scores", doubles="r2_avg")
def f8_fixed_candidates(spark, sf):
    return _fixed(spark, sf).scores.select(*KEYS, "candidate", "ordinal", "r2_avg")


@query(
    sql=f"with {v.BEST} select series_id, fold, candidate as best_candidate, (select count(*) from scores s where s.series_id = best.series_id and s.fold = best.fold) as n_candidates, {len(FEATURES)} as n_features, n_train from best",
)
def f16_fixed_summary(spark, sf):
    summary = _fixed(spark, sf).summary()
    return summary.select(*KEYS, "best_candidate", F.size("candidate_scores").cast("long").alias("n_candidates"), "n_features", "n_train")


@query(
    sql=f"with recursive {v.spread()} select series_id, date, pos, {_SCHEDULE}, candidate, {_WIDE} from predicted join spreads using (series_id, fold, pos) group by all",
    doubles=_WIDE_NAMES,
)
def c7_continued_backtest(spark, sf):
    """All but the last 45 rows of every series first, then the rest: the same rows as in one run."""
    path, panel = tables.shared_folder(spark, "continued"), b.panel(spark, sf)
    earlier = panel.where("pos < pos_total - 45").withColumn("pos_total", F.col("pos_total") - 45)
    continue_backtest(earlier, b.PLAN, FEATURES, TARGETS, path)
    return continue_backtest(panel, b.PLAN, FEATURES, TARGETS, path).forecasts


_LAYOUT = ", ".join(f"{t} as actual_{t}" for t in TARGETS)
_ACTUALS = [f"actual_{t}" for t in TARGETS]


@query(
    sql=f"with {v.V3} select series_id, date, pos, pos - {v._W} as k, (pos - {v._W}) // {v._R} as fold, (pos - {v._W}) % {v._R} = 0 as retrain, {_LAYOUT} from v3 where pos >= {v._W}",
    doubles=" ".join(_ACTUALS),
)
def c7_backtest_layout(spark, sf):
    """The schedule and actual values of the backtest's rows, without the fitted numbers."""
    done = _ridge(spark, sf).forecasts
    return done.filter("prediction_beta0_future_val is not null").select(*KEYS, "date", "pos", "k", "retrain", *_ACTUALS)


@query(
    sql=f"with {v.V3} select series_id, date, pos, 0 as k, 0 as fold, true as retrain, {_LAYOUT} from v3 where pos = pos_total - 1 and pos >= {v._W}",
    doubles=" ".join(_ACTUALS),
)
def c8_single_step_layout(spark, sf):
    done = _gaussian(spark, sf, WalkForward(b.PLAN.window, 100, 30, last_n=1)).forecasts
    return done.filter("std_beta0_future_val > 0").select(*KEYS, "date", "pos", "k", "retrain", *_ACTUALS)


@query(
    sql=f"with recursive {v.LAST_SPREAD} select series_id, date, pos, 0 as k, fold, true as retrain, candidate, {_WIDE} from predicted join spreads using (series_id, fold, pos) group by all",
    doubles=_WIDE_NAMES,
)
def c8_ridge_single_step(spark, sf):
    """The last window of every series only: fits, choice, predictions and deviations."""
    return _ridge(spark, sf, WalkForward(b.PLAN.window, 100, 30, last_n=1)).forecasts


@query()
def c8_single_step(spark, sf):
    """The last window of every series only."""
    return _gaussian(spark, sf, WalkForward(b.PLAN.window, 100, 30, last_n=1)).forecasts


@query(sql=f"with recursive {_EVIDENCE_LONG} select *, 'seven-day-ahead' as horizon from long", doubles="actual prediction prediction_std")
def c9_forecast_horizon(spark, sf):
    """Stored panel, configuration file, walk-forward, stored outputs; the stored forecasts come back."""
    root = tables.shared_folder(spark, "horizon")
    featured = b.featured(spark, sf)
    tables.write_table(featured, f"{root}/panel.parquet")
    forecast_horizon(spark, f"{root}/panel.parquet", CONFIG, "seven-day-ahead", b.PLAN, "ridge", output=root)
    return tables.read_samples(spark, f"{root}/results", "seven-day-ahead")


@query(sql=f"with {v.PROCESS_LONG} select *, 'seven-day-ahead' as horizon from long", doubles="actual prediction prediction_std")
def c9_process_horizon(spark, sf):
    """The whole flow with the process family, on windows and hyper-parameters that SQL can follow."""
    root = tables.shared_folder(spark, "process-horizon")
    tables.write_table(b.featured(spark, sf), f"{root}/panel.parquet")
    path = f"{root}/panel.parquet"
    forecast_horizon(spark, path, CONFIG, "seven-day-ahead", b.NARROW, "gaussian", output=root, n_samples=100, grid=b.ONE)
    return tables.read_samples(spark, f"{root}/results", "seven-day-ahead")


@query(sql=f"with {_FIXED_LONG} select *, 'seven-day-ahead' as horizon from long", doubles="actual prediction prediction_std")
def a11_result_sink(spark, sf):
    root = tables.shared_folder(spark, "results")
    run = _fixed(spark, sf)
    tables.write_table(run.long().select(F.lit("seven-day-ahead").alias("horizon"), "*"), root, ["horizon"])
    return tables.read_samples(spark, root, "seven-day-ahead")
