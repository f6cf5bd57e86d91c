"""Walk-forward windows as arithmetic on positions.

With window w, refit interval R, step s and embargo e, predictions sit at ``start + k*s`` and fold
f (predictions ``f*R .. f*R+R-1``) trains on positions ``start + f*R*s - w - e`` up to, not
including, ``start + f*R*s - e``. Membership is closed form, so folds are independent rows and
every refit runs at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.operators.panel import KEY


@dataclass(frozen=True)
class WalkForward:
    window: int = 252
    min_window: int = 100
    refit_every: int = 20
    step: int = 1
    embargo: int = 0
    last_n: int | None = None

    def __post_init__(self) -> None:
        if min(self.window, self.refit_every, self.step) < 1 or self.embargo < 0:
            raise ValueError("window, refit_every and step must be positive, embargo not negative")

    @property
    def stride(self) -> int:
        """Positions between two refits."""
        return self.refit_every * self.step

    @property
    def start(self) -> Column:
        """Position of the first prediction of a series."""
        first = F.lit(max(self.window, self.min_window) + self.embargo).cast("long")
        if self.last_n is None:
            return first
        windows = F.greatest(F.lit(0), F.ceil((F.col("pos_total") - first) / self.step))
        return first + F.greatest(F.lit(0), windows - self.last_n) * self.step

    @property
    def predictions(self) -> Column:
        """Number of predictions of a series."""
        return F.greatest(
            F.lit(0).cast("long"), F.ceil((F.col("pos_total") - self.start) / self.step)
        )

    @property
    def folds(self) -> Column:
        return F.ceil(self.predictions / self.refit_every)

    @property
    def first_fold(self) -> Column:
        """First fold a row trains; with ``last_fold`` an interval that may be empty."""
        offset = F.col("pos") + self.embargo - self.start
        return F.greatest(F.lit(0).cast("long"), F.floor(offset / self.stride) + 1)

    @property
    def last_fold(self) -> Column:
        offset = F.col("pos") + self.embargo - self.start
        return F.least(self.folds - 1, F.floor((offset + self.window) / self.stride))

    def fit_start(self, fold: Column) -> Column:
        return self.start + fold * self.stride - self.embargo - self.window

    def fit_end(self, fold: Column) -> Column:
        return self.start + fold * self.stride - self.embargo


def prediction_rows(panel: DataFrame, plan: WalkForward) -> DataFrame:
    """Rows to predict with k, fold, their own window ``[train_start, train_end)`` and refit flag."""
    since = F.col("pos") - plan.start
    return (
        panel.filter((since >= 0) & (since % plan.step == 0))
        .withColumn("k", (since / plan.step).cast("long"))
        .withColumn("fold", F.floor(F.col("k") / plan.refit_every))
        .withColumn("train_start", F.col("pos") - plan.embargo - plan.window)
        .withColumn("train_end", F.col("pos") - plan.embargo)
        .withColumn("retrain", F.col("k") % plan.refit_every == 0)
    )


def windows(panel: DataFrame, plan: WalkForward) -> DataFrame:
    return prediction_rows(panel, plan).select(
        *KEY, "k", "pos", "fold", "train_start", "train_end", "retrain"
    )


def training_rows(panel: DataFrame, plan: WalkForward) -> DataFrame:
    """Every row once per fold it trains: a linear fan-out of about window / refit interval."""
    return (
        panel.withColumns({"_lo": plan.first_fold, "_hi": plan.last_fold})
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn("fold", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )


def fold_groups(panel: DataFrame, plan: WalkForward, per_group: int) -> DataFrame:
    """Rows laid out for work on ``per_group`` neighbouring folds at a time.

    A group needs ``per_group * stride + window`` rows, so with ``per_group`` near
    window / stride each row is copied about twice, not window / stride times, before the shuffle.
    Rows predicted by the group's folds come along.
    """
    last_position = plan.start + plan.predictions * plan.step - plan.step
    own_fold = F.floor((F.col("pos") - plan.start) / plan.stride)
    predicted = F.col("pos").between(plan.start, last_position)
    lo = F.when(plan.first_fold <= plan.last_fold, plan.first_fold)
    hi = F.when(plan.first_fold <= plan.last_fold, plan.last_fold)
    own = F.when(predicted, own_fold)
    return (
        panel.withColumns({"_lo": F.least(lo, own), "_hi": F.greatest(hi, own)})
        .filter(F.col("_lo").isNotNull())
        .withColumn(
            "fold_group",
            F.explode(F.sequence(F.floor(F.col("_lo") / per_group), F.floor(F.col("_hi") / per_group))),
        )
        .drop("_lo", "_hi")
    )


def only_folds(rows: DataFrame, plan: WalkForward, per_group: int, only: DataFrame | None) -> DataFrame:
    """Rows of ``fold_groups`` with ``_start`` and the folds ``_low`` to ``_high`` of their group that are to be worked on.

    ``only`` (series_id, fold) names these; groups without any are left out. Without it they are all of the series.
    """
    rows = rows.withColumn("_start", plan.start)
    if only is None:
        return rows.withColumns({"_low": F.lit(0).cast("long"), "_high": (plan.folds - 1).cast("long")})
    group = F.expr(f"fold div {per_group}").alias("fold_group")
    spans = only.groupBy(*KEY, group).agg(F.min("fold").alias("_low"), F.max("fold").alias("_high"))
    return rows.join(spans, [*KEY, "fold_group"])
