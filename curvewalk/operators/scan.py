"""Ordered running totals and neighbour windows that no single hot key can overload.

A plain window over ``partitionBy(key).orderBy(...)`` puts a whole key into one task. Two
operators replace it everywhere in this package:

``ordered_scan``
    Running totals (dense positions are running totals of 1) and previous-row lookups. Rows are
    cut into *granules*: expressions that never decrease along the order, coarse to fine, such as
    ``year(date)`` or ``order_date, order_key div 2**20``. Totals per granule are one map-side
    combined aggregate; prefix sums run over those small tables level by level; each row then only
    needs its own finest granule. Choose granules so that every level has few children and the
    finest one is bounded.

``over_blocks``
    Window functions over a fixed number of neighbouring rows. With positions known, rows are
    grouped into blocks of ``size`` positions and the few rows just outside a block are copied
    into it, so any key spreads over as many tasks as it has blocks.

``decayed_mean``
    Means whose weights fall by a factor a position, however far they reach: a block of positions turns
    the state before it into the one after it, and only those small maps are followed along a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID_GRANULE = 1 << 20
#: Partitions over which rows without a place in an order are spread.
UNPLACED = 1024


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def _granule_offsets(
    table: DataFrame, keys: list[str], marks: list[str], sums: list[str], carries: list[str]
) -> DataFrame:
    """Exclusive prefix sums and latest earlier carry for every granule, one level per call."""
    parent = keys + marks[:-1]
    before = _before(W.partitionBy(*parent).orderBy(marks[-1]))
    local = [F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    local += [F.last(f"_c_{c}", ignorenulls=True).over(before).alias(f"_p_{c}") for c in carries]
    if len(marks) == 1:
        whole = W.partitionBy(*keys)
        totals = [F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums]
        return table.select(*keys, *marks, *local, *totals)

    mark = marks[-1]
    parents = table.groupBy(*parent).agg(
        *[F.sum(f"_t_{s}").alias(f"_t_{s}") for s in sums],
        *[
            F.max_by(f"_c_{c}", F.when(F.col(f"_c_{c}").isNotNull(), F.col(mark))).alias(f"_c_{c}")
            for c in carries
        ],
    )
    above = _granule_offsets(parents, keys, marks[:-1], sums, carries)
    above = above.select(
        *parent,
        *[F.col(f"_o_{s}").alias(f"_u_{s}") for s in sums],
        *[F.col(f"_p_{c}").alias(f"_v_{c}") for c in carries],
        *[f"{s}_total" for s in sums],
    )
    return (
        table.select(*keys, *marks, *local)
        .join(above, parent)
        .select(
            *keys,
            *marks,
            *[(F.col(f"_o_{s}") + F.col(f"_u_{s}")).alias(f"_o_{s}") for s in sums],
            *[F.coalesce(f"_p_{c}", f"_v_{c}").alias(f"_p_{c}") for c in carries],
            *[f"{s}_total" for s in sums],
        )
    )


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    granules: list[Column],
    sums: Mapping[str, Column] | None = None,
    carries: Mapping[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Append exclusive running totals ``<name>``, key totals ``<name>_total`` and previous values.

    ``sums`` maps a name to the amount each row adds (default ``pos``: 1, the dense 0-based
    position). ``carries`` maps a name to ``(value, condition)``; the result column holds the value
    of the nearest earlier row meeting the condition. The order must be total within a key. A row
    whose key or order is NULL has no place in it: it stays, with NULL in every added column, and
    counts for no other row.
    """
    sums = {"pos": F.lit(1)} if sums is None else dict(sums)
    carries = dict(carries or {})
    marks = [f"_g{i}" for i in range(len(granules))]
    tagged = df.withColumns(
        {m: g for m, g in zip(marks, granules)}
        | {f"_a_{s}": amount.cast("long") for s, amount in sums.items()}
        | {f"_b_{c}": F.when(cond, value) for c, (value, cond) in carries.items()}
    )
    # Rows without a place match no granule; a hash keeps them from meeting in one task.
    placed = F.expr(" and ".join(f"`{c}` is not null" for c in [*keys, *order, *marks]))
    spread = F.when(placed, 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(UNPLACED)))
    tagged = tagged.withColumn("_spread", spread)
    at = F.struct(*order)
    leaf = tagged.filter("_spread = 0").groupBy(*keys, *marks).agg(
        *[F.sum(f"_a_{s}").alias(f"_t_{s}") for s in sums],
        *[
            F.max_by(f"_b_{c}", F.when(F.col(f"_b_{c}").isNotNull(), at)).alias(f"_c_{c}")
            for c in carries
        ],
    )
    offsets = _granule_offsets(leaf, keys, marks, list(sums), list(carries))
    before = _before(W.partitionBy(*keys, *marks, "_spread").orderBy(*order))
    running = {
        s: F.coalesce(F.sum(f"_a_{s}").over(before), F.lit(0)) + F.col(f"_o_{s}") for s in sums
    }
    previous = {
        c: F.when(
            F.col("_spread") == 0,
            F.coalesce(F.last(f"_b_{c}", ignorenulls=True).over(before), F.col(f"_p_{c}")),
        )
        for c in carries
    }
    out = tagged.join(offsets.withColumn("_spread", F.lit(0).cast("long")), [*keys, *marks, "_spread"], "left")
    added = [f"{s}_total" for s in sums]
    return out.select(
        *df.columns,
        *[c.alias(n) for n, c in running.items()],
        *added,
        *[c.alias(n) for n, c in previous.items()],
    )


def over_blocks(
    df: DataFrame,
    keys: list[str],
    columns: Mapping[str, Callable],
    back: int = 0,
    ahead: int = 0,
    pos: str = "pos",
    size: int | None = None,
) -> DataFrame:
    """Append window columns that look at most ``back`` rows back and ``ahead`` rows ahead.

    ``columns`` maps a name to a function of the window, e.g.
    ``lambda w: F.avg("x").over(w.rowsBetween(-4, 0))``. Inside it ``_offset`` is the row's place
    relative to the start of the block, negative for rows copied from the block before. A row
    without a position gets NULL in the new columns.
    """
    size = size or max(4096, 8 * (back + ahead))
    first = F.greatest(F.lit(0), F.expr(f"({pos} - {ahead}) div {size}"))
    last = F.expr(f"({pos} + {back}) div {size}")
    window = W.partitionBy(*keys, "_block").orderBy(pos)
    nowhere = F.array((-1 - F.pmod(F.xxhash64(*df.columns), F.lit(UNPLACED))).cast("long"))
    blocks = F.when(F.col(pos).isNull(), nowhere).otherwise(F.sequence(first.cast("long"), last.cast("long")))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_offset", F.expr(f"{pos} - _block * {size}"))
        .withColumns({name: F.when(F.col(pos).isNotNull(), build(window)) for name, build in columns.items()})
        .filter(F.expr(f"{pos} is null or {pos} div {size} = _block"))
        .drop("_block", "_offset")
    )


#: How far the weight falls within a block, as a natural logarithm, and blocks that one task follows.
DECAY, BLOCKS = 256.0, 1 << 16


def decayed_mean(df: DataFrame, keys: list[str], column: str, keep: float, name: str, pos: str = "pos") -> DataFrame:
    """Append the mean of the values so far, each weighed by ``keep`` to the power of its distance in positions.

    A block of positions maps the sums (values, weights) before it to ``keep^size`` times them plus its own. Blocks are
    so long that this factor is e^-256: what reaches a block from before its last block with a value, and
    that one's predecessor, lies below a double's precision. So two carried rows a block give its start exactly, no row
    is copied, and gaps of any length keep their mean. NULL values weigh nothing but let time pass; a row without a
    position gets NULL.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    size = max(1, int(DECAY / -math.log(keep)))
    placed = F.col(pos).isNotNull()
    nowhere = (-1 - F.pmod(F.xxhash64(*df.columns), F.lit(UNPLACED))).cast("long")
    rows = df.withColumn("_block", F.when(placed, F.expr(f"{pos} div {size}")).otherwise(nowhere))
    rows = rows.withColumn("_offset", F.col(pos) - F.col("_block") * size)
    weight = F.when(F.col(column).isNotNull(), F.pow(F.lit(keep), size - 1 - F.col("_offset")))
    blocks = rows.where(placed).groupBy(*keys, "_block").agg(
        F.sum(F.col(column) * weight).alias("_num"), F.sum(weight).alias("_den")
    )
    granules, some = [F.expr(f"_block div {BLOCKS}")], F.col("_den").isNotNull()
    state = F.struct("_block", "_num", "_den")
    blocks = ordered_scan(blocks, keys, ["_block"], granules, sums={}, carries={"_prev": (state, some)})
    fall = F.pow(F.lit(keep), (F.col("_block") - F.col("_prev._block")) * size)
    both = [(F.col(c) + F.coalesce(fall * F.col(f"_prev.{c}"), F.lit(0.0))).alias(c) for c in ("_num", "_den")]
    blocks = blocks.select(*keys, "_block", *both)
    blocks = ordered_scan(blocks, keys, ["_block"], granules, sums={}, carries={"_in": (state, some)})
    before = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(F.col(column).isNotNull(), F.pow(F.lit(keep), -F.col("_offset")))
    reach = F.pow(F.lit(keep), (F.col("_block") - F.col("_in._block") - 1) * size + 1)
    rows = rows.join(blocks.select(*keys, "_block", "_in"), [*keys, "_block"], "left")
    rows = rows.withColumns({"_n": F.sum(F.col(column) * own).over(before), "_d": F.sum(own).over(before)})
    num, den = (F.col(a) + F.coalesce(reach * F.col(f"_in.{b}"), F.lit(0.0)) for a, b in (("_n", "_num"), ("_d", "_den")))
    mean = F.when(F.col("_d").isNull(), F.try_divide("_in._num", "_in._den")).otherwise(F.try_divide(num, den))
    return rows.select(*df.columns, F.when(placed, mean).alias(name))


def value_granules(value: Column) -> list[Column]:
    """Two order-preserving levels of a double: signed log scale at 2^-8 and 2^-30 resolution.

    Independent of the data, so no statistics pass is needed, and bounded for any data: a key has
    under 400,000 coarse granules, a coarse granule at most 2^22 fine ones, and a fine granule at
    most about 2^22 distinct doubles (above 1e-12 in size; closer to zero it is 1e-21 wide). NULL
    and NaN must be gone.
    """
    scale = F.signum(value) * F.log1p(F.least(F.abs(value), F.lit(1e290)) * 1e12)
    return [F.coalesce(F.floor(scale * steps).cast("long"), F.lit(0)) for steps in (1 << 8, 1 << 30)]


def value_runs(
    df: DataFrame, keys: list[str], value: str, counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct value: rows at it, rows below it and rows in the key.

    ``counts`` names row counters (default ``n``: every row). For a counter ``n`` the columns are
    ``n`` (rows below), ``n_here`` and ``n_total``. Ties collapse map-side before any shuffle.
    """
    counts = {"n": F.lit(True)} if counts is None else dict(counts)
    runs = df.groupBy(*keys, value).agg(
        *[F.count_if(cond).alias(f"{name}_here") for name, cond in counts.items()]
    )
    return ordered_scan(
        runs,
        keys,
        [value],
        value_granules(F.col(value)),
        sums={name: F.col(f"{name}_here") for name in counts},
    )


def expand_runs(runs: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """Back from value runs to one row per input row, with its 0-based ``rank`` in value order.

    Tie runs are cut into chunks of ``limit`` and rebalanced before they expand, so a value held by
    a large share of the rows does not expand in one task.
    """
    below, here = F.col("n"), F.col("n_here")
    chunks = runs.withColumn("_start", F.explode(F.sequence(below, below + here - 1, F.lit(limit))))
    stop = F.least(F.col("_start") + limit - 1, below + here - 1)
    return (
        chunks.hint("rebalance")
        .withColumn("rank", F.explode(F.sequence(F.col("_start"), stop)))
        .drop("_start")
    )


def attach(df: DataFrame, small: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """Join a table with one row per key to rows of which a key may hold any share.

    Both sides carry a salt, so a key's rows go to many tasks, and an aggregate by key afterwards
    sums within those before its own shuffle.
    """
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return rows.join(salted, [*keys, "_salt"]).drop("_salt")
