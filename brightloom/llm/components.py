"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.shared import joined, materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node in ``links`` (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and contracts
    the graph to those ends, until no link is left. A node in very many links is no hot key for long: its links become one after
    a contraction, minima are pre-aggregated before each shuffle, and joins are left to adaptive splitting.
    A missing node or link from a node to itself is ignored; an empty table gives an empty one.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = materialize(joined(hooks, up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            top = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = materialize(joined(roots, top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = joined(joined(links, a, "a"), b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = materialize(links.where("a <> b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
