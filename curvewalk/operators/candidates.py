"""Candidate grids: Bayesian-ridge priors and Gaussian-process kernels."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prior names and the value of all four gamma hyper-priors.
PRIORS = {
    "alpha_1e-6": 1e-6,
    "alpha_1e-4": 1e-4,
    "alpha_1e-2": 1e-2,
    "alpha_1": 1.0,
    "alpha_10": 10.0,
    "alpha_100": 100.0,
}

# Kernels used by default, then the opt-in ones.
KERNELS = ("ExpSineSquared", "RBF", "RationalQuadratic")
EXTRA_KERNELS = ("DotProduct", "Matern", "Combined_RBF_ExpSine", "RBF_ARD")
#: The kernel with one length for each feature.
RELEVANCE_KERNEL = "RBF_ARD"

NUGGET = 1e-6
# Search bounds of the hyper-parameters.
BOUNDS = {"length": (1e-2, 1e2), "mixture": (1e-5, 1e5), "period": (1e-2, 1e2), "constant": (1e-3, 1e3), "noise": (1e-5, 1e5)}


@dataclass(frozen=True)
class KernelGrid:
    """Hyper-parameter values tried for every kernel, and how many searches start from the best of them.

    A search climbs the evidence along its gradient inside BOUNDS; without restarts the grid's values are all.
    """

    length: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    mixture: tuple[float, ...] = (0.1, 1.0, 10.0)
    period: tuple[float, ...] = (0.1, 1.0, 10.0)
    constant: tuple[float, ...] = tuple(10.0 ** (i / 2) for i in range(-6, 7))
    noise: tuple[float, ...] = tuple(10.0 ** (i / 2) for i in range(-10, 11))
    restarts: int = 3

    def shapes(self, kernel: str) -> list[dict[str, float]]:
        names = {
            "RBF": ["length"],
            "Matern": ["length"],
            "RationalQuadratic": ["length", "mixture"],
            "ExpSineSquared": ["length", "period"],
            "Combined_RBF_ExpSine": ["length", "period"],
            "DotProduct": ["length"],
            "RBF_ARD": ["length"],
        }[kernel]
        return [dict(zip(names, values)) for values in product(*[getattr(self, n) for n in names])]


def check_candidates(names: list[str] | tuple[str, ...], known: list[str]) -> None:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown candidates {unknown}; candidates are {known}")


def _literal(family: str, candidate: str, ordinal: int, params: dict[str, float]) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        F.lit(candidate).alias("candidate"),
        F.lit(ordinal).alias("ordinal"),
        F.create_map(*[F.lit(v) for item in params.items() for v in item]).alias("params"),
    )


def prior_grid() -> Column:
    """The ridge grid as an array literal of (family, candidate, ordinal, params)."""
    return F.array(*[_literal("ridge", name, i, {"alpha": v}) for i, (name, v) in enumerate(PRIORS.items())])


def kernel_grid(kernels: tuple[str, ...] = KERNELS, grid: KernelGrid | None = None) -> Column:
    """One entry per kernel and shape; constant and noise values vary inside the fit."""
    check_candidates(kernels, [*KERNELS, *EXTRA_KERNELS])
    return F.array(
        *[
            _literal("gaussian", kernel, i, shape)
            for i, kernel in enumerate(kernels)
            for shape in (grid or KernelGrid()).shapes(kernel)
        ]
    )


def with_candidates(folds: DataFrame, grid: Column) -> DataFrame:
    """Every fold once per grid entry, expanded in place."""
    return folds.select("*", F.inline(grid))
