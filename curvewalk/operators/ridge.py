"""Ridge candidates fitted from sufficient statistics: one matrix of product sums per fold serves all priors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curvewalk.functions import ratio
from curvewalk.operators.candidates import PRIORS, check_candidates
from curvewalk.operators.folds import WalkForward, fold_groups, only_folds, prediction_rows
from curvewalk.operators.panel import KEY
from curvewalk.session import task_count

#: Scores that the sums of a fold give without its rows.
SUM_SCORES = ["euclidean_rmse", "r2_avg", "r2_flat"]
LINEAR_SCHEMA = (
    "series_id string, fold bigint, family string, candidate string, ordinal int, n_train bigint, "
    "intercept array<double>, coef array<array<double>>, " + ", ".join(f"{c} double" for c in SUM_SCORES)
)
FIT_SCHEMA = (
    LINEAR_SCHEMA + ", noise array<double>, x_mean array<double>, basis array<array<double>>, spread array<array<double>>"
)
ROUNDS = 300
TOLERANCE = 1e-3


def folds_per_group(plan: WalkForward) -> int:
    """Neighbouring folds handled together: enough that a row is copied about twice."""
    return max(1, plan.window // plan.stride)


def gram_names(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


GRAM_SCHEMA = "series_id string, fold bigint, anchor array<double>, gram array<double>"


def fold_grams(
    panel: DataFrame,
    plan: WalkForward,
    features: list[str],
    targets: list[str],
    shift: bool = True,
    only: DataFrame | None = None,
) -> DataFrame:
    """Upper triangle of Σzzᵀ, z = (1, features, targets), for every (series, fold) as ``gram``.

    Rows go to groups of neighbouring folds, about twice each; a task holds one group, window plus
    ``per_group * stride`` rows. Whatever the window, a row of a group is multiplied once: see ``_sliding``.
    With ``shift`` z holds differences from ``anchor``, the group's first row, which the fits add back: the
    sums keep their digits at any level. Without it the sums are of the raw values and ``anchor`` is zero.
    ``only`` (series_id, fold) names the folds wanted, if not all are.
    """
    columns = [*features, *targets]
    per_group = folds_per_group(plan)
    upper = np.triu_indices(1 + len(columns))
    rows = fold_groups(panel.select(*KEY, "pos", "pos_total", *columns), plan, per_group)
    rows = only_folds(rows, plan, per_group, only)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        folds, lows, highs = bounds(group, plan, per_group)
        x = group[columns].to_numpy(float)
        anchor = x[0] if shift else np.zeros(len(columns))
        z = np.column_stack([np.ones(len(x)), x - anchor])
        series = group["series_id"].iloc[0]
        made = [(series, f, anchor.tolist(), g[upper].tolist()) for f, g in zip(folds, _sliding(z, lows, highs))]
        return pd.DataFrame(made, columns=["series_id", "fold", "anchor", "gram"])

    keys = [*KEY, "fold_group"]
    return rows.repartition(task_count(panel), *keys).groupBy(*keys).applyInPandas(add, GRAM_SCHEMA)


def bounds(group: pd.DataFrame, plan: WalkForward, per_group: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The group's folds, and where the training rows of each begin and end among its rows, sorted by position."""
    first, pos = group.iloc[0], group["pos"].to_numpy()
    mine = int(first["fold_group"]) * per_group
    folds = np.arange(max(mine, int(first["_low"])), min(mine + per_group, int(first["_high"]) + 1))
    ends = int(first["_start"]) + folds * plan.stride - plan.embargo
    return folds.tolist(), np.searchsorted(pos, ends - plan.window), np.searchsorted(pos, ends)


def _sliding(z: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[np.ndarray]:
    """zᵀz over each range of rows, without taking any row up twice or subtracting sums.

    All ranges hold the end of the first one, as a group has at most window / stride folds. From there running sums
    go back to every range's begin and on to every range's end; a range is one of each.
    """
    if not len(lows):
        return
    middle, width = highs[0], z.shape[1]
    back, total = [], np.zeros((width, width))
    for low, edge in zip(lows[::-1], [middle, *lows[:0:-1]]):
        total = total + z[low:edge].T @ z[low:edge]
        back.append(total)
    total, begin = np.zeros((width, width)), middle
    for before, high in zip(back[::-1], highs):
        total = total + z[begin:high].T @ z[begin:high]
        begin = high
        yield before + total


def _full(flat: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles."""
    upper = np.triu_indices(size)
    full = np.zeros((len(flat), size, size))
    full[:, upper[0], upper[1]] = flat
    full[:, upper[1], upper[0]] = flat
    return full


def _centred(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and centred product sums of a stack of Gram matrices."""
    n = grams[:, 0, 0]
    mean = grams[:, 0, 1:] / n[:, None]
    return n, mean, grams[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]


def sum_scores(grams: np.ndarray, coef: np.ndarray, anchor: np.ndarray) -> dict[str, np.ndarray]:
    """RMSE of target vectors and both R² of fits with an intercept, from the sums of their training rows.

    Axes: fold, candidate, target, feature. The residuals' sum of squares is a quadratic form of the coefficients;
    an undefined score is NaN.
    """
    p = coef.shape[-1]
    n, mean, centred = _centred(grams)
    pull = np.einsum("fit->fti", centred[:, :p, p:])[:, None]
    spread = np.clip(np.einsum("ftt->ft", centred[:, p:, p:]), 0.0, None)[:, None]
    bent = np.einsum("fcti,fij->fctj", coef, centred[:, :p, :p])
    sse = np.clip(spread - 2 * (coef * pull).sum(-1) + (bent * coef).sum(-1), 0.0, None)
    level = (mean + anchor)[:, p:]
    apart = n[:, None] * (level - level.mean(-1, keepdims=True)) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        found = {
            "euclidean_rmse": np.sqrt(sse.sum(-1) / n[:, None]),
            "r2_avg": (1 - sse / spread).mean(-1),
            "r2_flat": 1 - sse.sum(-1) / (spread[:, 0] + apart).sum(-1)[:, None],
        }
    return {k: np.where(np.isfinite(v), v, np.nan) for k, v in found.items()}


def _linear_rows(batch: pd.DataFrame, grams: np.ndarray, names: list[str], got: dict[str, np.ndarray]) -> list[dict]:
    """Columns of LINEAR_SCHEMA for each candidate, from slopes and the means of differences from the anchor."""
    anchor = np.stack(batch["anchor"].to_numpy())
    coef, p = got["coef"], got["coef"].shape[-1]
    _, mean, _ = _centred(grams)
    level = (mean + anchor)[:, None, p:] - np.einsum("fctj,fj->fct", coef, (mean + anchor)[:, :p])
    scores = sum_scores(grams, coef, anchor)
    return [
        {
            "series_id": batch["series_id"],
            "fold": batch["fold"],
            "family": "ridge",
            "candidate": name,
            "ordinal": i,
            "n_train": grams[:, 0, 0].astype(np.int64),
            "intercept": level[:, i].tolist(),
            "coef": coef[:, i].tolist(),
            **{k: v[:, i] for k, v in scores.items()},
        }
        for i, name in enumerate(names)
    ]


def _stacks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """A few folds at a time: a stack holds several size x size matrices for each."""
    at_once = max(1, 2_000_000 // (size * size))
    for batch in (whole[i : i + at_once] for whole in batches for i in range(0, len(whole), at_once)):
        yield batch, _full(np.stack(batch["gram"].to_numpy()), size)


def fixed_ridge(grams: DataFrame, penalties: dict[str, float], n_features: int, n_targets: int) -> DataFrame:
    """Centred ridge with given penalties: one fitted row per (series, fold, penalty)."""
    if min(penalties.values()) <= 0:
        raise ValueError("penalties must be positive")
    names, p = list(penalties), n_features

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, full in _stacks(batches, 1 + n_features + n_targets):
            _, _, centred = _centred(full)
            added = np.eye(p) * np.array(list(penalties.values()))[:, None, None]
            solved = np.linalg.solve(centred[:, None, :p, :p] + added, centred[:, None, :p, p:])
            got = {"coef": solved.transpose(0, 1, 3, 2)}
            yield pd.concat([pd.DataFrame(r) for r in _linear_rows(batch, full, names, got)])

    return grams.mapInPandas(fit, LINEAR_SCHEMA)


def solve_evidence(grams: np.ndarray, p: int, priors: np.ndarray) -> dict[str, np.ndarray]:
    """Evidence-maximised ridge for a stack of Gram matrices and all priors at once.

    Iterates noise precision a and weight precision l in the eigenbasis of the centred XᵀX
    (MacKay 1992, Tipping 2001). Axes: fold, prior, target, feature.
    """
    n, mean, centred = _centred(grams)
    values, basis = np.linalg.eigh(centred[:, :p, :p])
    values = np.clip(values, 0.0, None)[:, None, None, :]
    pull = np.einsum("fij,fit->ftj", basis, centred[:, :p, p:])[:, None]
    yy = np.clip(np.einsum("ftt->ft", centred[:, p:, p:]), 0.0, None)[:, None, :]
    count = n[:, None, None]
    prior = priors[None, :, None]
    shape = np.broadcast_shapes(yy.shape, prior.shape)
    a = np.broadcast_to(1.0 / (yy / count + np.finfo(float).eps), shape).copy()
    l = np.ones(shape)
    running = np.ones(shape, dtype=bool)

    def weights() -> np.ndarray:
        return pull / (values + (l / a)[..., None])

    before = None
    for _ in range(ROUNDS):
        w = weights()
        sse = np.clip(yy - 2 * (w * pull).sum(-1) + (values * w * w).sum(-1), 0.0, None)
        gamma = (a[..., None] * values / (l[..., None] + a[..., None] * values)).sum(-1)
        new_l = (gamma + 2 * prior) / ((w * w).sum(-1) + 2 * prior)
        new_a = (count - gamma + 2 * prior) / (sse + 2 * prior)
        l, a = np.where(running, new_l, l), np.where(running, new_a, a)
        coef = np.einsum("fij,fctj->fcti", basis, w)
        if before is not None:
            running &= np.abs(coef - before).sum(-1) >= TOLERANCE
            if not running.any():
                break
        before = coef
    coef = np.einsum("fij,fctj->fcti", basis, weights())
    return {
        "coef": coef,
        "noise": 1.0 / a,
        "spread": 1.0 / (a[..., None] * values + l[..., None]),
        "basis": basis,
        "x_mean": mean[:, :p],
    }


def evidence_ridge(
    grams: DataFrame, n_features: int, n_targets: int, priors: dict[str, float] | None = None
) -> DataFrame:
    """One fitted row per (series, fold, prior); all priors share the fold's Gram matrix."""
    priors = PRIORS if priors is None else priors
    check_candidates(list(priors), list(PRIORS))
    names, strengths = list(priors), np.array(list(priors.values()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, full in _stacks(batches, 1 + n_features + n_targets):
            got = solve_evidence(full, n_features, strengths)
            x_mean = got["x_mean"] + np.stack(batch["anchor"].to_numpy())[:, :n_features]
            basis = got["basis"].transpose(0, 2, 1).tolist()
            yield pd.concat(
                [
                    pd.DataFrame(
                        row
                        | {
                            "noise": got["noise"][:, i].tolist(),
                            "x_mean": x_mean.tolist(),
                            "basis": basis,
                            "spread": got["spread"][:, i].tolist(),
                        }
                    )
                    for i, row in enumerate(_linear_rows(batch, full, names, got))
                ]
            )

    return grams.mapInPandas(fit, FIT_SCHEMA)


def weight_columns(n_features: int, n_targets: int) -> list[str]:
    """Flat columns ``w<target>_<feature>`` (feature 0 is the intercept) from the fit's arrays.

    Taken out of the arrays once per fit, not once per (row, fit) pair.
    """
    found = []
    for j in range(n_targets):
        found.append(f"intercept[{j}] as w{j}_0")
        found += [f"coef[{j}][{i}] as w{j}_{i + 1}" for i in range(n_features)]
    return found


def linear_predictions(features: list[str], targets: list[str]) -> list[str]:
    """``prediction_<target>`` as plain SQL arithmetic on the flat weights."""
    terms = [
        " + ".join([f"w{j}_0", *[f"`{x}` * w{j}_{i}" for i, x in enumerate(features, 1)]])
        for j in range(len(targets))
    ]
    return [f"{term} as `prediction_{t}`" for term, t in zip(terms, targets)]


def _with_fits(
    panel: DataFrame,
    plan: WalkForward,
    fits: DataFrame,
    columns: list[str],
    kept: list[str],
    per_group: int,
    work: Callable[[pd.DataFrame, pd.DataFrame, slice], pd.DataFrame],
    schema: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """``work(rows, fits, training rows)`` of every fold, rows and fits together by group of neighbouring folds.

    A row is shuffled about window / (per_group * stride) + 1 times; no table pairs rows with fits.
    """
    rows = fold_groups(panel.select(*KEY, "pos", "pos_total", *columns), plan, per_group)
    rows = only_folds(rows, plan, per_group, only)
    slim = fits.select(*KEY, F.expr(f"fold div {per_group}").alias("fold_group"), "fold", "candidate", "ordinal", "coef", "intercept", *kept)
    keys, tasks, names = [*KEY, "fold_group"], task_count(panel), StructType.fromDDL(schema).names

    def run(group: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        folds, lows, highs = bounds(group, plan, per_group) if len(group) else ([], [], [])
        by_fold = dict(list(fitted.sort_values("ordinal").groupby("fold")))
        made = [work(group, by_fold[f], slice(low, high)) for f, low, high in zip(folds, lows, highs) if f in by_fold]
        return pd.concat(made) if made else pd.DataFrame(columns=names)

    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (rows, slim))
    return left.cogroup(right).applyInPandas(run, schema)


def _guesses(x: np.ndarray, fitted: pd.DataFrame) -> np.ndarray:
    """Predictions (row, candidate, target) of a fold's fits by one matrix product."""
    coef = np.array([np.stack(c) for c in fitted["coef"]])
    flat = x @ coef.reshape(-1, coef.shape[-1]).T
    return flat.reshape(len(x), *coef.shape[:2]) + np.stack(fitted["intercept"].to_numpy())


#: Predictions of training rows that a task makes at a time.
FITTED_ROWS = 200_000


def in_sample(
    panel: DataFrame, plan: WalkForward, fits: DataFrame, features: list[str], targets: list[str], candidates: int = len(PRIORS)
) -> DataFrame:
    """Predictions of every candidate on its own training rows; ``candidates`` is how many fits a fold has."""
    per_group = max(1, min(folds_per_group(plan), FITTED_ROWS // (plan.window * candidates)))

    def work(group: pd.DataFrame, fitted: pd.DataFrame, train: slice) -> pd.DataFrame:
        rows = group.iloc[train]
        guess = _guesses(rows[features].to_numpy(float), fitted)
        parts = []
        for i, fit in enumerate(fitted.itertuples()):
            part = rows[[*KEY, "date", "pos", *targets]].copy()
            part["fold"], part["candidate"], part["ordinal"] = fit.fold, fit.candidate, fit.ordinal
            for j, t in enumerate(targets):
                part[f"prediction_{t}"] = guess[:, i, j]
            parts.append(part)
        return pd.concat(parts)

    schema = "series_id string, fold bigint, candidate string, ordinal int, date date, pos bigint, "
    schema += ", ".join([f"`{t}` double" for t in targets] + [f"`prediction_{t}` double" for t in targets])
    columns = ["date", *dict.fromkeys([*features, *targets])]
    return _with_fits(panel, plan, fits, columns, [], per_group, work, schema)


def training_scores(
    panel: DataFrame,
    plan: WalkForward,
    fits: DataFrame,
    features: list[str],
    targets: list[str],
    only: DataFrame | None = None,
) -> DataFrame:
    """Four training scores per (series, fold, candidate) of the fits; ``only`` as for their sums.

    Three come with the fits, from sums. The mean cosine similarity needs the rows: one matrix product a fold.
    """

    def work(group: pd.DataFrame, fitted: pd.DataFrame, train: slice) -> pd.DataFrame:
        rows = group.iloc[train]
        y = rows[targets].to_numpy(float)
        guess = _guesses(rows[features].to_numpy(float), fitted)
        with np.errstate(divide="ignore", invalid="ignore"):
            lengths = np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(guess, axis=2)
            cosine = (np.einsum("rt,rct->rc", y, guess) / lengths).mean(axis=0)
        out = fitted[[*KEY, "fold", "candidate", "ordinal", "n_train"]].copy()
        out["cosine_similarity"] = np.where(np.isfinite(cosine), cosine, np.nan)
        return pd.concat([out, fitted[SUM_SCORES]], axis=1)

    schema = "series_id string, fold bigint, candidate string, ordinal int, n_train bigint, "
    schema += ", ".join(f"{c} double" for c in ["cosine_similarity", *SUM_SCORES])
    columns = list(dict.fromkeys([*features, *targets]))
    return _with_fits(panel, plan, fits, columns, ["n_train", *SUM_SCORES], folds_per_group(plan), work, schema, only)


def predict(
    panel: DataFrame,
    plan: WalkForward,
    fits: DataFrame,
    features: list[str],
    targets: list[str],
    std_mode: str = "posterior",
    due: DataFrame | None = None,
) -> DataFrame:
    """Predictions and standard deviations for the rows each fold has to forecast, or for the ``due`` ones of them.

    ``std_mode='posterior'`` uses weight and noise uncertainty; ``'row_spread'`` is the spread over
    prediction rows, which is 0 for the one-row predictions made here.
    """
    if std_mode not in ("posterior", "row_spread"):
        raise ValueError(f"unknown std_mode {std_mode!r}; modes are posterior and row_spread")
    flat = fits.selectExpr("*", *weight_columns(len(features), len(targets)))
    rows = (prediction_rows(panel, plan) if due is None else due).join(flat, [*KEY, "fold"])
    p = range(len(features))
    if std_mode == "posterior":
        along = [" + ".join(f"(`{features[i]}` - x_mean[{i}]) * basis[{k}][{i}]" for i in p) for k in p]
        rows = rows.withColumn("_u", F.expr(f"array({', '.join(along)})"))
        stds = [
            "sqrt(" + " + ".join([f"noise[{j}]", *[f"_u[{k}] * _u[{k}] * spread[{j}][{k}]" for k in p]]) + ")"
            for j in range(len(targets))
        ]
    else:
        stds = ["0D"] * len(targets)
    return rows.selectExpr(
        *KEY, "date", "pos", "k", "fold", "retrain", "candidate",
        *[f"`{t}` as `actual_{t}`" for t in targets],
        *linear_predictions(features, targets),
        *[f"{s} as `std_{t}`" for s, t in zip(stds, targets)],
    )


def coefficient_importance(fits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Mean absolute coefficient over targets, normalised to sum 1 within each key."""
    names = F.array(*[F.lit(f) for f in features])
    size = (
        fits.select(*keys, F.explode("coef").alias("row"))
        .select(*keys, F.posexplode("row").alias("i", "w"))
        .groupBy(*keys, "i")
        .agg(F.avg(F.abs("w")).alias("size"))
    )
    whole = F.sum("size").over(W.partitionBy(*keys))
    return size.select(
        *keys, names[F.col("i")].alias("feature"), ratio(F.col("size"), whole).alias("importance")
    )
