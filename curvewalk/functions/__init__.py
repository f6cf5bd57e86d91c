from curvewalk.functions.draws import hashed_normal
from curvewalk.functions.numeric import (
    EXACT_KS,
    clean,
    dot,
    exact_kolmogorov_p,
    kolmogorov_p,
    normal_quantile,
    normal_upper,
    ratio,
    shapiro_francia_p,
    total,
)

__all__ = [
    "EXACT_KS", "clean", "dot", "exact_kolmogorov_p", "hashed_normal", "kolmogorov_p", "normal_quantile", "normal_upper",
    "ratio", "shapiro_francia_p", "total",
]
