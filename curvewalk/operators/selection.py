"""Order statistics and distribution gaps by counting: count cells, keep those that matter, count finer ones.

A value's cells (coarse, fine) and itself are ever finer marks that keep its order. Each pass over the rows adds them
up to counts by mark within tasks, so what is shuffled are counts of cells, and of single values only in the few fine
cells that are left. Results are exact, with ties.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewalk.functions import clean, ratio
from curvewalk.operators.scan import value_granules
from curvewalk.sources.tables import materialize

MARKS = ["_coarse", "_fine", "_value"]


def _marked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a value and a key, with their marks."""
    placed = F.expr(" and ".join(f"`{c}` is not null" for c in [*keys, value]))
    coarse, fine = value_granules(F.col(value))
    return rows.where(placed).withColumns({"_coarse": coarse, "_fine": fine, "_value": F.col(value)})


def _before(column: str, group: list[str], mark: str) -> Column:
    window = W.partitionBy(*group).orderBy(mark).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def order_statistics(
    df: DataFrame, keys: list[str], columns: list[str], positions: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """(keys, column_name, n, one column a position) for every key and column that has values.

    ``positions`` maps a name to a function of the number of values that gives a 0-based place in value order. NULL and
    NaN are no values; rows with a NULL key count nowhere. All columns and positions share the passes; the cells that
    hold a wanted place, at most one for each, are stored between them.
    """
    by = [*keys, "column_name"]
    long = df.select(*keys, *columns).unpivot(keys, columns, "column_name", "_raw")
    rows = _marked(long.select(*by, clean("_raw").alias("_raw")), by, "_raw").drop("_raw")
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), place(F.col("_total")).cast("long").alias("rank")) for name, place in positions.items()]
    )
    spots = None
    for depth, mark in enumerate(MARKS):
        path = [*by, *MARKS[:depth]]
        inside = rows if spots is None else rows.join(spots.select(*path).distinct(), path)
        counts = inside.groupBy(*path, mark).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_below", _before("_n", path, mark))
        if spots is None:
            counts = counts.withColumn("_total", F.sum("_n").over(W.partitionBy(*by)))
            each = counts.select("*", F.inline(wanted))
        else:
            each = counts.join(spots, path)
        here = (F.col("_below") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("_n"))
        each = each.where(here).select(*path, mark, "_total", "name", (F.col("rank") - F.col("_below")).alias("rank"))
        spots = materialize(each, "spots")
    found = [F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in positions]
    return spots.groupBy(*by).agg(F.max("_total").alias("n"), *found)


def largest_gap(rows: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, gap, n_first, n_second): the largest distance between the distribution functions of two samples in one column.

    ``first`` says which rows are the first sample. The gap at a cell's end is known from counts; inside a cell it
    can't exceed what all of one sample's rows before all of the other's would give. Only cells that could beat the
    largest gap seen so far are looked into.
    """
    tagged = _marked(rows.withColumn("_first", first), keys, value)
    best, open_ = None, None
    for depth, mark in enumerate(MARKS):
        path = [*keys, *MARKS[:depth]]
        inside = tagged if open_ is None else tagged.join(open_.select(*path, "_a0", "_b0", "_na", "_nb", "_best"), path)
        start = [] if open_ is None else [F.first(c).alias(c) for c in ("_a0", "_b0", "_na", "_nb", "_best")]
        counts = inside.groupBy(*path, mark).agg(F.count_if("_first").alias("_a"), F.count_if(~F.col("_first")).alias("_b"), *start)
        if open_ is None:
            whole = W.partitionBy(*keys)
            sums = {"_na": F.sum("_a").over(whole), "_nb": F.sum("_b").over(whole)}
            counts = counts.withColumns(sums | {"_a0": F.lit(0), "_b0": F.lit(0), "_best": F.lit(0.0)})
        counts = counts.withColumns(
            {"_a0": F.col("_a0") + _before("_a", path, mark), "_b0": F.col("_b0") + _before("_b", path, mark)}
        )
        a0, b0 = ratio(F.col("_a0"), F.col("_na")), ratio(F.col("_b0"), F.col("_nb"))
        a1, b1 = ratio(F.col("_a0") + F.col("_a"), F.col("_na")), ratio(F.col("_b0") + F.col("_b"), F.col("_nb"))
        counts = counts.withColumns({"_edge": F.abs(a1 - b1), "_reach": F.greatest(a1 - b0, b1 - a0)})
        counts = materialize(counts.drop("_a", "_b"), "gap-cells")
        now = counts.groupBy(*keys).agg(F.greatest(F.max("_edge"), F.max("_best")).alias("_now"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
        found = now if best is None else best.join(now.select(*keys, F.col("_now").alias("_later")), keys, "left").select(
            *keys, F.greatest("_now", "_later").alias("_now"), "_na", "_nb"
        )
        best = materialize(found, "gaps")
        open_ = counts.join(best.select(*keys, "_now"), keys).where("_reach > _now").withColumn("_best", F.col("_now")).drop("_now")
    return best.select(*keys, F.col("_now").alias("gap"), F.col("_na").alias("n_first"), F.col("_nb").alias("n_second"))
