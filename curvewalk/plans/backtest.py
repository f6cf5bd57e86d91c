"""The walk-forward backtest of one model family as a single dataflow over all series and folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewalk.operators import gaussian, ridge
from curvewalk.operators.candidates import KERNELS, PRIORS, KernelGrid
from curvewalk.operators.evaluate import compare_models
from curvewalk.operators.folds import WalkForward, prediction_rows
from curvewalk.operators.panel import KEY, load_panel, with_positions
from curvewalk.operators.report import summary_report
from curvewalk.operators.samples import draw_samples
from curvewalk.operators.scores import best_candidates, candidate_rank, check_metric
from curvewalk.sources import tables

SCORES = ["cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat", "log_marginal_likelihood"]
RIDGE_SAMPLE_SCALE = 0.01


@dataclass(frozen=True)
class Backtest:
    """Lazy results: wide forecasts, candidate scores, winners, and the targets they cover."""

    forecasts: DataFrame
    scores: DataFrame
    best: DataFrame
    targets: list[str]
    features: list[str]
    family: str
    metric: str

    def samples(self, n_samples: int = 1000, scale: float | None = None) -> DataFrame:
        """Predictive draws: the process spread, or for ridge the fixed spread."""
        if self.family == "ridge" and scale is None:
            scale = RIDGE_SAMPLE_SCALE
        return draw_samples(self.forecasts, self.targets, [*KEY, "date"], n_samples, scale)

    def long(self) -> DataFrame:
        return forecasts_long(self.forecasts, self.targets)

    def summary(self) -> DataFrame:
        return model_summary(self.scores, self.metric, len(self.features))

    def report(self) -> DataFrame:
        """One line per series and target: error metrics, the candidate that won most folds, and the count."""
        name = F.concat_ws(" ", "series_id", "target").alias("series")
        rows = self.long().select(
            name, "date", "fold", "best_candidate", F.col("actual").alias("y_true"), F.col("prediction").alias("y_pred")
        )
        metrics = compare_models(rows, ["series"], ["date"], [F.year("date")])
        won = rows.groupBy("series", "best_candidate").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds"))
        best = won.groupBy("series").agg(
            F.max_by("best_candidate", F.struct("folds", "best_candidate")).alias("best_kernel"),
            F.sum("n").alias("predictions_count"),
        )
        return summary_report(metrics.join(best, "series"), "series")

    def importance(self) -> DataFrame:
        if self.family == "ridge":
            return ridge.coefficient_importance(self.best, [*KEY, "fold"], self.features)
        return gaussian.process_importance(self.best, [*KEY, "fold"], self.features)


def forecasts_long(forecasts: DataFrame, targets: list[str]) -> DataFrame:
    """One row per (series, date, target)."""
    items = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.col(f"actual_{t}").alias("actual"),
                F.col(f"prediction_{t}").alias("prediction"),
                F.col(f"std_{t}").alias("prediction_std"),
            )
            for t in targets
        ]
    )
    return forecasts.select(
        *KEY, "date", "k", "fold", F.col("candidate").alias("best_candidate"), "retrain", F.inline(items)
    )


def model_summary(scores: DataFrame, metric: str, n_features: int) -> DataFrame:
    """Per fold: the winner, its parameters and evidence, every candidate's scores, and counts."""
    listed = F.struct("candidate", *[c for c in SCORES if c in scores.columns])
    optional = [c for c in ("params", "log_marginal_likelihood") if c in scores.columns]
    winner = F.struct(F.col("candidate").alias("best_candidate"), "n_train", *optional)
    summary = scores.groupBy(*KEY, "fold").agg(
        F.max_by(winner, candidate_rank(metric)).alias("winner"),
        F.array_sort(F.collect_list(listed)).alias("candidate_scores"),
        F.array_sort(F.collect_list("candidate")).alias("available_candidates"),
    )
    return summary.select(
        *KEY, "fold", "winner.*", "candidate_scores", "available_candidates",
        F.lit(n_features).alias("n_features"),
    )


def ridge_backtest(
    panel: DataFrame,
    plan: WalkForward,
    features: list[str],
    targets: list[str],
    metric: str = "cosine_similarity",
    priors: dict[str, float] = PRIORS,
    std_mode: str = "posterior",
    store: bool = True,
    fit: Callable[[DataFrame], DataFrame] | None = None,
) -> Backtest:
    """Ridge family. Fits and scores feed later steps, so ``store`` keeps them in the shared folder.

    ``fit`` replaces the evidence fit: from fold sums to rows of ``ridge.LINEAR_SCHEMA``, for instance with
    given penalties. Without noise estimates use ``std_mode="row_spread"``.
    """
    check_metric(metric)
    grams = ridge.fold_grams(panel, plan, features, targets)
    fits = fit(grams) if fit else ridge.evidence_ridge(grams, len(features), len(targets), priors)
    if store:
        fits = tables.materialize(fits, "ridge-fits")
    scores = ridge.training_scores(panel, plan, fits, features, targets)
    if store:
        scores = tables.materialize(scores, "ridge-scores")
    chosen = best_candidates(scores, [*KEY, "fold"], metric)
    best = fits.join(chosen.select(*KEY, "fold", "candidate"), [*KEY, "fold", "candidate"])
    forecasts = ridge.predict(panel, plan, best, features, targets, std_mode)
    return Backtest(forecasts, scores, best, targets, features, "ridge", metric)


def gaussian_backtest(
    panel: DataFrame,
    plan: WalkForward,
    features: list[str],
    targets: list[str],
    metric: str = "cosine_similarity",
    kernels: tuple[str, ...] = KERNELS,
    grid: KernelGrid | None = None,
    inducing: int | None = None,
    standardize: bool = False,
    store: bool = True,
) -> Backtest:
    """Gaussian-process family. ``store`` keeps the fits, so that several outputs don't fit again."""
    check_metric(metric)
    fits = gaussian.fit_predict(panel, plan, features, targets, kernels, grid, inducing, standardize)
    if store:
        fits = tables.materialize(fits, "gaussian-fits")
    best = best_candidates(fits, [*KEY, "fold"], metric)
    rows = prediction_rows(panel, plan).select(
        *KEY, "date", "pos", "k", "retrain", *[F.col(t).alias(f"actual_{t}") for t in targets]
    )
    forecasts = rows.join(gaussian.predictions(best, targets), [*KEY, "pos"])
    return Backtest(
        forecasts, fits.drop("predictions"), best.drop("predictions"), targets, features, "gaussian", metric
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def continue_backtest(
    panel: DataFrame,
    plan: WalkForward,
    features: list[str],
    targets: list[str],
    path: str,
    family: str = "ridge",
    metric: str = "cosine_similarity",
    **options,
) -> Backtest:
    """Do what a backtest below ``path`` has not done yet, and give all of it back.

    The tables ``scores`` (all candidates), ``best`` (winning fits) and ``forecasts`` hold what was done; a run adds the
    folds and rows that are missing in them. Folds and positions are fixed by the plan, so appended dates leave earlier ones
    as they are: a new date refits a series only if it opens a fold. A run that was lost has added nothing, or its
    folds without their forecasts, which the next run then makes. Plan, features, family and options must stay.
    Rows may only be appended; ``last_n`` would move the folds.
    """
    if plan.last_n is not None:
        raise ValueError("a backtest that goes on predicts every window; last_n must be None")
    check_metric(metric)
    if family not in ("ridge", "gaussian"):
        raise ValueError(f"unknown family {family!r}; families are ['gaussian', 'ridge']")
    spark, keys = panel.sparkSession, [*KEY, "fold"]
    due, done = prediction_rows(panel, plan), _stored(spark, f"{path}/forecasts")
    if done is not None:
        due = due.join(done.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    due = tables.materialize(due, "due-rows")
    wanted, known = due.select(*keys).distinct(), _stored(spark, f"{path}/best")
    if known is not None:
        wanted = wanted.join(known.select(*keys), keys, "left_anti")
    wanted = tables.materialize(wanted, "due-folds")
    if known is None or not wanted.isEmpty():
        if family == "ridge":
            grams = ridge.fold_grams(panel, plan, features, targets, only=wanted)
            priors = options.get("priors", PRIORS)
            fits = tables.materialize(ridge.evidence_ridge(grams, len(features), len(targets), priors), "ridge-fits")
            scores = ridge.training_scores(panel, plan, fits, features, targets, wanted)
        else:
            fits = gaussian.fit_predict(panel, plan, features, targets, only=wanted, **options).drop("predictions")
            fits = scores = tables.materialize(fits, "gaussian-fits")
        scores = tables.materialize(scores, "due-scores")
        chosen = best_candidates(scores, keys, metric).select(*keys, "candidate")
        # The winners last: a fold counts as done once they are written.
        scores.write.mode("append").parquet(f"{path}/scores")
        fits.join(chosen, [*keys, "candidate"]).write.mode("append").parquet(f"{path}/best")
    best = spark.read.parquet(f"{path}/best")
    mine = best.join(due.select(*keys).distinct(), keys, "left_semi")
    if family == "ridge":
        forecasts = ridge.predict(panel, plan, mine, features, targets, options.get("std_mode", "posterior"), due)
    else:
        how = {k: options[k] for k in ("inducing", "standardize") if k in options}
        found = gaussian.predict_stored(panel, plan, mine, features, targets, **how)
        actual = [F.col(t).alias(f"actual_{t}") for t in targets]
        forecasts = due.select(*KEY, "date", "pos", "k", "retrain", *actual).join(found, [*KEY, "pos"])
    if done is None or not due.isEmpty():
        forecasts.write.mode("append").parquet(f"{path}/forecasts")
    # A lost run can have left scores whose winners it didn't reach; they are the same ones.
    scores = spark.read.parquet(f"{path}/scores").dropDuplicates([*keys, "candidate"])
    return Backtest(spark.read.parquet(f"{path}/forecasts"), scores, best, targets, features, family, metric)


def forecast_horizon(
    spark: SparkSession,
    panel_path: str,
    config_path: str,
    horizon: str,
    plan: WalkForward,
    family: str = "gaussian",
    metric: str = "cosine_similarity",
    output: str | None = None,
    n_samples: int = 1000,
    **options,
) -> Backtest:
    """Configuration, panel, walk-forward and, with ``output``, the result tables of one horizon.

    ``options`` are those of the family's backtest, such as ``kernels`` or ``priors``.
    """
    config = tables.feature_config(spark, config_path)
    features, targets = tables.features(config, horizon), tables.targets(config)
    source = tables.table_source(spark, panel_path)
    if "series_id" not in source.columns:  # one series
        source = source.withColumn("series_id", F.lit("ALL"))
    needed = [*KEY, "date", *dict.fromkeys([*features, *targets])]
    missing = [c for c in needed if c not in source.columns]
    if missing:
        raise ValueError(f"{panel_path} lacks columns {missing}; it has {source.columns}")
    panel = with_positions(load_panel(source.select(*needed), features, targets))
    if output:  # every step below reads it
        panel = tables.materialize(panel, "panel")
    run = {"gaussian": gaussian_backtest, "ridge": ridge_backtest}
    if family not in run:
        raise ValueError(f"unknown family {family!r}; families are {sorted(run)}")
    result = run[family](panel, plan, features, targets, metric, store=output is not None, **options)
    if output:
        result = replace(result, forecasts=tables.materialize(result.forecasts, "forecasts"))
        tag = F.lit(horizon).alias("horizon")
        month = F.date_format("date", "yyyy-MM").alias("month")
        tables.write_table(result.long().select(tag, "*"), f"{output}/results", ["horizon"])
        tables.write_table(result.summary().select(tag, "*"), f"{output}/summaries", ["horizon"])
        samples = result.samples(n_samples).select(tag, month, "*")
        tables.write_table(samples, f"{output}/samples", ["horizon", "month"])
    return result
