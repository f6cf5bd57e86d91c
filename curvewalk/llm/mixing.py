"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is a stream of words, its documents in the order of a hash, cut into blocks. Its target fixes exactly how
many blocks it gives. These quotas are split among the output shards by a tree: a node halves its shards and draws,
for each source in turn, how many of its blocks go to the left half, from the hypergeometric distribution given the
draws before. A leaf knows its blocks of each source; they are taken from a permutation of the source's blocks,
disjoint between shards, and put in a random order inside the shard. Everything here is column expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.llm.tables import numbered
from curvewalk.sources.tables import materialize

WORD = r"[^\x20\x09-\x0D]++"
#: A prime above any number of blocks: steps of it visit every block of a source once.
PRIME = 2**31 - 1
#: Rows of a source that a task puts in order at a time, on average.
CELL_ROWS = 4_000
#: Standard deviations around the mode that a draw can reach; what lies beyond is below a double's precision.
REACH = 9


@dataclass(frozen=True)
class Mixture:
    """Documents with the words taken of each, the pieces that make up the shards, block quotas, and the sources."""

    documents: DataFrame
    pieces: DataFrame
    quotas: DataFrame
    sources: DataFrame


def _named(values: dict[str, Column], use) -> Column:
    """use(struct of the values), with each of them evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), use)[0]


def hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked ones are among drawn of whole, for a uniform u in [0, 1): its distribution, inverted.

    Probabilities are followed from the mode by the ratios of neighbours, up and then down.
    """

    def bounds(v: Column) -> Column:
        whole, marked, drawn = v["whole"], v["marked"], v["drawn"]
        low, high = F.greatest(F.lit(0), drawn + marked - whole), F.least(drawn, marked)
        share, rest = marked / whole, F.greatest(whole - 1, F.lit(1))
        wide = F.ceil(REACH * F.sqrt(drawn * share * (1 - share) * (whole - drawn) / rest)) + REACH
        peak = F.floor((drawn + 1) * ((marked + 1) / (whole + 2)))
        return _named({"v": v, "low": low, "high": high, "wide": wide, "peak": peak}, inside)

    def inside(w: Column) -> Column:
        mode = F.greatest(w["low"], F.least(w["high"], w["peak"]))
        ends = {"v": w["v"], "mode": mode, "ups": F.least(w["high"] - mode, w["wide"]), "downs": F.least(mode - w["low"], w["wide"])}
        return F.when(w["low"] == w["high"], w["low"].cast("long")).otherwise(_named(ends, _invert))

    start = {"whole": whole, "marked": marked, "drawn": drawn, "u": u}
    return F.when(whole <= 0, F.lit(0).cast("long")).otherwise(_named(start, bounds))


def _invert(e: Column) -> Column:
    """The value whose range of cumulated probabilities holds u, of e (v, mode, ups, downs)."""
    whole, marked, drawn = e["v"]["whole"], e["v"]["marked"], e["v"]["drawn"]

    def up(k: Column) -> Column:
        return ((marked - k) / (k + 1)) * ((drawn - k) / (whole - marked - drawn + k + 1))

    def down(k: Column) -> Column:
        return (k / (marked - k + 1)) * ((whole - marked - drawn + k) / (drawn - k + 1))

    def walk(begin: Column, steps: Column, ratio, step: int, target: Column | None) -> Column:
        """Follow the steps: (probability, sum so far, k, and the first k whose sum is over the target)."""
        picked = F.lit(None).cast("long")
        start = F.struct(F.lit(1.0).alias("p"), begin.alias("sum"), e["mode"].cast("long").alias("k"), picked.alias("pick"))

        def go(a: Column, _: Column) -> Column:
            p, k = a["p"] * ratio(a["k"]), a["k"] + step
            pick = a["pick"] if target is None else F.coalesce(a["pick"], F.when(a["sum"] + p > target, k))
            return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), k.cast("long").alias("k"), pick.alias("pick"))

        none = F.array().cast("array<int>")
        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps.cast("int"))).otherwise(none), start, go)

    def pick(s: Column) -> Column:
        target, mode = s["target"], e["mode"].cast("long")
        return F.coalesce(
            F.when(target < 1.0, mode),
            F.when(target < s["above"], walk(F.lit(1.0), e["ups"], up, 1, target)["pick"]),
            walk(s["above"], e["downs"], down, -1, target)["pick"],
            mode,
        )

    above, below = walk(F.lit(1.0), e["ups"], up, 1, None)["sum"], walk(F.lit(0.0), e["downs"], down, -1, None)["sum"]

    def aim(t: Column) -> Column:
        return _named({"above": t["above"], "target": e["v"]["u"] * (t["above"] + t["below"])}, pick)

    return _named({"above": above, "below": below}, aim)


def _uniform(*columns) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """sources (source, source_size) with place, weight and target.

    Sources are numbered by code point, null last, and weigh the weights in turn. They share the given share of all
    sizes by weight, none above most times its size; what such limits leave over is shared again by the others.
    The level at which the shares stand is raised until it holds; the driver sees sums alone.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    placed = numbered(sources, "source").select("source", "source_size", "place", weight.alias("weight"))
    placed = materialize(placed, "weighted")
    limit = F.col("source_size") * most
    level, reached = 0.0, -1
    whole = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        row = placed.where(full).agg(F.count("*"), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if row[0] == reached:
            break
        reached = row[0]
        left = whole[1] - row[2]
        level = (share * whole[0] - row[1]) / left if left > 0 else float("inf")
    target = F.when(full, limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return placed.withColumn("target", target)


def _cut(sources: DataFrame, block_words: int, blocks: int, seed: int) -> DataFrame:
    """sources with their blocks and draws: all blocks for each whole round, then the first ones of a permutation.

    The permutation sends place p to block (step * p + shift) mod n_blocks. The block with the fewest words, the
    last one, is at place short_at. The last draw is cut so that the words taken equal the rounded target.
    """
    whole = F.broadcast(sources.agg(F.sum("source_size").alias("all_words")))  # one row
    size = F.col("source_size")
    block = F.greatest(F.lit(block_words).cast("long"), F.ceil(F.col("all_words") / blocks).cast("long"))
    cut = sources.join(whole).where(size > 0).withColumn("block", block)
    cut = cut.withColumn("n_blocks", F.ceil(size / F.col("block")).cast("long"))
    cut = cut.withColumn("lacking", F.col("n_blocks") * F.col("block") - size)
    cut = cut.withColumn("step", F.lit(PRIME) % F.col("n_blocks"))
    cut = cut.withColumn("short_at", F.pmod(F.xxhash64("source", F.lit(seed)), "n_blocks"))
    cut = cut.withColumn("shift", F.pmod(F.col("n_blocks") - 1 - F.col("step") * F.col("short_at"), "n_blocks"))
    words = F.round("target").cast("long")
    cut = cut.withColumns({"rounds": F.floor(words / size).cast("long"), "rest": words % size})
    plain = F.expr("rest div block")
    whole_draws = F.when(plain < F.col("short_at"), plain).otherwise(F.expr("(rest + lacking) div block"))
    cut = cut.withColumn("whole_draws", whole_draws)
    passed = F.when(F.col("whole_draws") > F.col("short_at"), F.col("lacking")).otherwise(F.lit(0))
    cut = cut.withColumn("last_words", F.col("rest") - F.col("whole_draws") * F.col("block") + passed)
    draws = F.col("rounds") * F.col("n_blocks") + F.col("whole_draws") + (F.col("last_words") > 0).cast("long")
    return cut.withColumn("draws", draws).drop("all_words")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, place, quota) of quotas (place, quota): the leaves of the splitting tree.

    Shards get numbers of blocks at most one apart. A level of the tree is one grouping by node, in which the sources'
    draws follow each other; levels are stored. Its rows are sources times nodes, whatever the number of documents.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    every = int(quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])

    def upto(shard: Column) -> Column:
        return F.floor(shard.cast("long") * F.lit(every) / shards)

    nodes = quotas.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "place", "quota")
    widest = shards
    while widest > 1:
        low, high = F.col("low"), F.col("high")
        middle = F.expr("(low + high) div 2").cast("int")
        held = nodes.groupBy("low", "high").agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("held"))
        held = held.withColumns({"middle": middle, "room": (upto(middle) - upto(low)).cast("long")})
        whole = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        none = F.array().cast("array<long>")
        start = F.struct(whole.alias("whole"), F.col("room").alias("room"), none.alias("given"))

        def draw(a: Column, x: Column) -> Column:
            u = _uniform("low", "high", x["place"], F.lit(seed))
            left = {"left": hypergeometric(a["whole"], x["quota"], a["room"], u)}
            return _named(
                left,
                lambda d: F.struct(
                    (a["whole"] - x["quota"]).alias("whole"),
                    (a["room"] - d["left"]).alias("room"),
                    F.concat(a["given"], F.array(d["left"])).alias("given"),
                ),
            )

        given = F.when(high - low > 1, F.aggregate("held", start, draw, lambda a: a["given"])).otherwise(F.transform("held", lambda x: x["quota"]))
        drawn = held.select("low", "high", "middle", F.inline(F.arrays_zip("held", given.alias("left"))))
        drawn = materialize(drawn.select("low", "high", "middle", "held.*", "left"), "quota-level")
        left_end = F.when(high - low > 1, F.col("middle")).otherwise(high).alias("high")
        lefts = drawn.select("low", left_end, "place", F.col("left").alias("quota"))
        rights = drawn.where(high - low > 1).select(F.col("middle").alias("low"), "high", "place", (F.col("quota") - F.col("left")).alias("quota"))
        nodes = lefts.unionByName(rights)
        widest = (widest + 1) // 2
    return nodes.select(F.col("low").alias("shard"), "place", "quota")


def _streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized rows, copies apart, with their source's columns and begin: the place of their first word in its stream."""
    cells = max(1, -(-sized.count() // CELL_ROWS))
    rows = sized.withColumn("key", F.xxhash64("doc_id", "body", F.lit(1)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"))
    sums = rows.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    known = sources.withColumnRenamed("source", "source_")
    sums = sums.join(known, sums["source"].eqNullSafe(known["source_"])).drop("source_")
    sums = sums.withColumnsRenamed({"source": "source_", "cell": "cell_"})
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["source_"]) & (rows["cell"] == sums["cell_"]))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    rows = rows.withColumn("copy", copy)
    begin = F.col("offset") + F.col("ahead") + F.col("copy") * F.col("size")
    return rows.withColumn("begin", begin.cast("long")).drop("key", "cell", "cell_", "source_", "ahead", "offset", "copies")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    shards: int = 16,
    block_words: int = 256,
    blocks: int = 1 << 20,
    seed: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Mix all documents so that the sources' words stand in the ratio of their weights.

    Sources in order of code point, null last, weigh the weights in turn and share the given share of all words;
    none gives more than most times its words, the excess is shared again by weight. A source whose target exceeds
    its words is taken in whole rounds and then a part; a source's taken words are its target, rounded.

    documents: (doc_id, size, source, source_size, target, taken), one row per input row. pieces: (shard, mix_order,
    source, doc_id, body, copy, round, first, words), runs of words of a document; a shard is its pieces in order of
    mix_order, first. quotas: (shard, place, quota), blocks by source; sources: the sources with target, blocks and draws.

    Blocks have block_words words, or more so that there are about blocks of them in all; draws per shard come from a
    splitting tree. A null text counts as empty; texts without words are never taken. Repeated rows are rows of their
    own and lie beside each other in the stream. The result depends on the rows alone, not on their order or
    partitions. An empty table gives empty ones; other columns are ignored.
    """
    if min(weights, default=0) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("body"),
    )
    sized = materialize(slim.groupBy("source", "doc_id", "size", "body").agg(F.count("*").alias("copies")), "sized")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = materialize(source_targets(sources, weights, share, most), "targets")
    cut = materialize(_cut(targets, block_words, blocks, seed), "blocks")
    quotas = split_quotas(cut.select("place", F.col("draws").alias("quota")), shards, seed)
    quotas = materialize(quotas, "quotas")
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranged = quotas.withColumn("from", F.coalesce(F.sum("quota").over(earlier), F.lit(0))).where("quota > 0")
    draws = ranged.withColumn("nth", F.explode(F.sequence("from", F.col("from") + F.col("quota") - 1)))
    own = cut.select("place", "n_blocks", "step", "shift", "draws", "last_words", F.col("block").alias("width"))
    # Counted from some draw on, so that the cut last draws of all sources don't meet in the last shard.
    turned = (F.col("nth") + F.pmod(F.xxhash64("place", F.lit(seed + 1)), "draws")) % F.col("draws")
    draws = draws.join(own, "place").withColumn("draw", turned).select(
        "place",
        "shard",
        F.expr("draw div n_blocks").alias("round"),
        F.expr("(step * (draw % n_blocks) + shift) % n_blocks").alias("block_at"),
        F.when((F.col("draw") == F.col("draws") - 1) & (F.col("last_words") > 0), F.col("last_words")).otherwise(F.col("width")).alias("limit"),
        F.xxhash64("place", "draw", F.lit(seed)).alias("mix_order"),
    )
    rows = materialize(_streams(sized, targets.join(cut.select("place", "block"), "place", "left")), "streams")
    end = F.col("begin") + F.col("size")
    some = rows.where("size > 0").select(
        "place", "source", "doc_id", "body", "copy", "begin", "block", end.alias("end"),
        F.explode(F.sequence(F.expr("begin div block"), F.expr("(begin + size - 1) div block"))).alias("block_at"),
    )
    inside = F.col("block_at") * F.col("block")
    pieces = some.join(draws, ["place", "block_at"]).select(
        "shard", "mix_order", "place", "source", "doc_id", "body", "copy", "round", "begin",
        (F.greatest("begin", inside) - F.col("begin")).alias("first"),
        (F.least("end", inside + F.col("block"), inside + F.col("limit")) - F.greatest("begin", inside)).alias("words"),
    ).where("words > 0")
    # Streams don't overlap, so a place in a source names a document that has words.
    taken = pieces.groupBy("place", "begin").agg(F.sum("words").alias("words"))
    taken = taken.select(F.col("place").alias("place_"), F.col("begin").alias("begin_"), "words")
    joined = rows.join(taken, (rows["place"] == taken["place_"]) & (rows["begin"] == taken["begin_"]) & (rows["size"] > 0), "left")
    documents = joined.select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("words", F.lit(0).cast("long")).alias("taken")
    )
    return Mixture(documents, pieces.drop("place", "begin"), quotas, cut)
