"""Quality rules: fixed limits, and robust multivariate outliers within each language and source."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.tables import body_key, map_columns
from curvewalk.llm.textstats import statistics
from curvewalk.sources.tables import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
#: Transformed statistics: log of the mean word length and square roots of shares, with the least scale of each.
#: The least scales keep a group in which nearly all rows agree from rejecting every other row. Each is so small that its
#: statistic can reject alone: ten times it is reached by 36 % repeated lines, and by 25 % words in repeated windows.
FLOORS = {"length": 0.05, "symbols": 0.05, "capitals": 0.03, "marks": 0.03, "again": 0.06, "repeats": 0.05}
#: Weak limits that stand for a table's own spread while it has few rows.
WIDE = {"length": 0.15, "symbols": 0.15, "capitals": 0.06, "marks": 0.06, "again": 0.06, "repeats": 0.05}
#: Rows at which a group's own estimate and that of the group above it weigh the same.
EVEN = 200
NAMES = list(FLOORS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Share of the rows whose covariance determinant is minimised.
COVERAGE = 0.75
STEPS = 4
#: Width of the histogram cells for medians, and of those of log distances.
CELL, RING = 0.01, 0.05


def text_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        body_key(text_col).alias("body"),
    )

    def run(doc_id, text, lang, source, body) -> dict:
        rows = np.array([statistics(t) for t in text.to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        return {"doc_id": doc_id, "lang": lang, "source": source, "body": body} | dict(zip(COUNTS, rows.T))

    schema = "doc_id long, lang string, source string, body long, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_columns(slim, run, schema)


def _share(part: str, whole: str) -> Column:
    return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def transformed(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {
            "length": F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))),
            "symbols": _share("n_symbols", "n_words"),
            "capitals": _share("n_capitals", "word_chars"),
            "marks": _share("n_marks", "word_chars"),
            "again": _share("n_dup_lines", "n_lines"),
            "repeats": _share("n_repeat_words", "n_words"),
        }
    )


def robust_scatter(rows: DataFrame, salts: int) -> DataFrame:
    """Minimum-covariance-determinant estimates of rows (key, <NAMES>): (key, n, mean, scatter, inverse).

    The start is the median and the median deviation of each statistic; each concentration step takes the
    COVERAGE share of a key's rows with the smallest distance and gives their mean and covariance, which never
    raises the determinant. A step is one aggregation to (key, ring of distances): counts and moments of the
    rings, partly summed before the shuffle, from which the inner rings are added up. All rows count, and a
    key's rows are never brought together.
    """
    cells = rows.select("key", F.posexplode(F.array(*NAMES)).alias("dim", "value"))
    cells = cells.groupBy("key", "dim", F.round(F.col("value") / CELL).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    state = "key string, n long, mean array<double>, scatter array<double>, inverse array<double>"
    found = materialize(cells.groupBy("key").applyInPandas(_start, state), "scatter")
    for _ in range(STEPS):
        ring = F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-6))) / RING).cast("int")
        moments = [F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)]
        moments += [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]
        rings = with_distance(rows, found, salts).groupBy("key", ring.alias("ring")).agg(F.count("*").alias("n"), *moments)
        found = materialize(rings.groupBy("key").applyInPandas(_concentrate, state), "scatter")
    return found


def _start(cells: pd.DataFrame) -> pd.DataFrame:
    mean, scale = np.zeros(P), np.array(list(FLOORS.values()))
    for dim, part in cells.groupby("dim"):
        part = part.sort_values("cell")
        middle = _weighted_median(part.cell.to_numpy(), part.n.to_numpy())
        off = np.abs(part.cell.to_numpy() - middle)
        order = np.argsort(off, kind="stable")
        spread = _weighted_median(off[order], part.n.to_numpy()[order])
        mean[dim], scale[dim] = middle * CELL, max(scale[dim], 1.4826 * spread * CELL)
    n = int(cells.loc[cells.dim == 0, "n"].sum())
    return _row(cells.key.iloc[0], n, mean, np.diag(scale**2))


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    sums = np.cumsum(weights)
    return float(values[np.searchsorted(sums, (sums[-1] + 1) // 2)])


def _concentrate(rings: pd.DataFrame) -> pd.DataFrame:
    rings = rings.sort_values("ring")
    n = rings.n.to_numpy()
    inner = np.searchsorted(np.cumsum(n), COVERAGE * n.sum()) + 1
    part, count = rings.iloc[:inner], n[:inner].sum()
    mean = np.array([part[f"s{i}"].sum() for i in range(P)]) / count
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = part[f"s{i}_{j}"].sum() / count - mean[i] * mean[j]
    # The inner rows spread less than all rows: scale as for a normal distribution, then add the least scales.
    cov = cov * 1.3 + np.diag(np.array(list(FLOORS.values())) ** 2)
    return _row(rings.key.iloc[0], int(n.sum()), mean, cov)


def _row(key: str, n: int, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    both = {"scatter": [cov.ravel().tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()]}
    return pd.DataFrame({"key": [key], "n": [n], "mean": [mean.tolist()]} | both)


def shrunk(found: DataFrame) -> DataFrame:
    """(key, mean, inverse) of the groups "2...", language and source: their estimates drawn towards those above them.

    A group of n rows weighs n / (n + EVEN) against its language, that against all rows, and those against the weak
    limits WIDE, at every size alike. What the two means differ by widens the scatter.
    """
    state = "key string, mean array<double>, scatter array<double>, inverse array<double>"

    def draw(batches):
        for batch in batches:
            made = []
            for r in batch.itertuples():
                own, above = r.n / (r.n + EVEN), EVEN / (r.n + EVEN)
                mean, other = np.array(r.mean), np.array(r.mean if r.mean_above is None else r.mean_above)
                wide = np.diag(np.array(list(WIDE.values())) ** 2) if r.scatter_above is None else np.array(r.scatter_above).reshape(P, P)
                gap = mean - other
                cov = own * np.array(r.scatter).reshape(P, P) + above * wide + own * above * np.outer(gap, gap)
                made.append((r.key, (own * mean + above * other).tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(made, columns=["key", "mean", "scatter", "inverse"])

    def under(level: str, above: DataFrame) -> DataFrame:
        own = found.where(F.col("key").startswith(level)).withColumn("parent", _parent(level))
        above = above.select(F.col("key").alias("parent"), F.col("mean").alias("mean_above"), F.col("scatter").alias("scatter_above"))
        joined = own.join(above, "parent", "left").select("key", "n", "mean", "scatter", "mean_above", "scatter_above")
        return materialize(joined.mapInPandas(draw, state), "shrunk")

    top = found.limit(0).select("key", "mean", "scatter")
    return under("2", under("1", under("0", top))).select("key", "mean", "inverse")


def _parent(level: str) -> Column:
    if level == "2":
        return F.concat(F.lit("1"), F.substring_index(F.expr("substring(key, 2)"), "\0", 1))
    return F.lit("0" if level == "1" else "none")


def with_distance(rows: DataFrame, found: DataFrame, salts: int) -> DataFrame:
    """rows with d2, the squared distance from their key's estimate; null for keys without one.

    The salt splits the rows of a large key in case the estimates are too many for Spark to broadcast.
    """
    salted = found.select("key", "mean", "inverse").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64(*NAMES), F.lit(salts)).cast("int"))
    joined = keyed.join(salted, ["key", "salt"], "left")
    off = [F.col(c) - F.col("mean")[i] for i, c in enumerate(NAMES)]
    terms = [off[i] * off[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i, j in PAIRS]
    return joined.withColumn("d2", reduce(lambda a, b: a + b, terms)).drop("salt", "mean", "inverse")


def judge_quality(
    docs: DataFrame,
    radius: float = 10.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: (doc_id, body, counts, base_failed, distance, judged_by, kept).

    base_failed: under 20 words, or over 30 in 100 words inside repeated 8-word windows. kept is false then, or
    if the row's robust distance from its language and source exceeds radius. Estimates are of the rows that passed the
    base rules; those of few rows are drawn towards their language's, all rows' and fixed weak limits (``shrunk``), so
    every row is judged, in a table of any size; distance is null only where no row of its language and source passed.
    A null text has no words, a null language or source counts as the empty string; rows are judged each,
    repeated ones alike. An empty table gives no rows. Other columns are ignored.
    """
    stats = materialize(transformed(text_statistics(docs, id_col, text_col, lang_col, source_col)), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    levels = [F.concat(F.lit("2"), "lang", F.lit("\0"), "source"), F.concat(F.lit("1"), "lang"), F.lit("0")]
    stats = stats.withColumn("base_failed", failed).withColumn("key", levels[0])
    salts = max(1, -(-stats.count() // 100_000))
    members = stats.where("not base_failed").select(F.explode(F.array(*levels)).alias("key"), *NAMES)
    judged = with_distance(stats, shrunk(robust_scatter(members, salts)), salts)
    return judged.select(
        "doc_id",
        "body",
        *COUNTS,
        "base_failed",
        F.sqrt(F.when(F.col("d2") < 0, 0.0).otherwise(F.col("d2"))).alias("distance"),
        F.col("key").alias("judged_by"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= radius**2, F.lit(True))).alias("kept"),
    )
