"""Normal draws that depend only on their labels, never on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def _uniform(label: Column) -> Column:
    word = F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / 4294967296.0


def hashed_normal(sample_id: Column, target: str) -> Column:
    """Box-Muller over two hashed uniforms of (sample id, target)."""
    stem = F.concat(sample_id.cast("string"), F.lit(f"-{target}-"))
    radius = F.sqrt(-2.0 * F.ln(_uniform(F.concat(stem, F.lit("r")))))
    return radius * F.cos(TWO_PI * _uniform(F.concat(stem, F.lit("a"))))
