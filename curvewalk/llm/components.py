"""Connected components as a loop of joins over a shrinking edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewalk.sources.tables import materialize


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class_id, component_id, group) of nodes (node, class_id): the smallest class_id over links (a, b).

    group is the same for the nodes of a component and for no others, also where all its class_ids are null.

    Each round hooks every node to its smallest neighbour or itself, follows the hooks to their roots and keeps
    the links between different roots, so the number of linked nodes at least halves. Links, hooks and
    roots are written to the shared folder each round; the driver sees counts only.
    """
    links = materialize(edges.where("a <> b").select("a", "b"), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low"))
        hooks = hooks.select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        roots = _roots(materialize(hooks, "hooks"))
        maps.append(roots)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = materialize(
            links.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    owned = nodes.withColumn("top", F.col("node"))
    for roots in maps:
        step = roots.select(F.col("node").alias("top"), "root")
        owned = owned.join(step, "top", "left").select(
            "node", "class_id", F.coalesce("root", "top").alias("top")
        )
    lowest = owned.groupBy("top").agg(F.min("class_id").alias("component_id"))
    return owned.join(lowest, "top").select("node", "class_id", "component_id", F.col("top").alias("group"))


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow hooks (node, root) to the end; every pass doubles the length of the paths followed."""
    while True:
        next_hook = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = materialize(
            hooks.join(next_hook, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")),
            "hooks",
        )
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks
