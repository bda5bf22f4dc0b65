"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def named(roots: DataFrame, node: str, root: str) -> DataFrame:
    return roots.select(F.col("node").alias(node), F.col("root").alias(root))


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least id that links (a, b) lead to. Nodes without links don't appear.

    Each round every node takes the least of itself and its neighbours, then that one's choice and so on to the end (paths halve
    each time), and nodes of one choice become one: links between them go, others are drawn between choices. A node with links
    joins another, so there are ever fewer; it ends when no link is left. All of it stays in tables; a hub's rows are
    pre-aggregated, and its joins are some that adaptive execution can split.

    The tables are written and read back, not checkpointed: a checkpoint hands what the optimizer has inferred on to all that is made
    of it, each round has several times that of the last one, and the driver's time and memory go with it.
    """
    scratch = Scratch(links.sparkSession)
    cut = lambda df: scratch.stored(df, "round")
    edges = cut(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        chosen = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        while True:
            further = cut(chosen.join(named(chosen, "root", "further"), "root").select("node", F.col("further").alias("root"), (F.col("further") < F.col("root")).alias("moved")))
            chosen = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        if roots is None:
            roots = chosen
        else:
            roots = cut(roots.join(named(chosen, "root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        drawn = edges.join(named(chosen, "a", "x"), "a").join(named(chosen, "b", "y"), "b").where("x <> y")
        edges = cut(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots, "roots")
    scratch.drop()
    return found


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """components() of the links that led to roots and of these: only the roots of these are linked anew."""
    if roots is None:
        return components(links)
    over = links.join(named(roots, "a", "x"), "a", "left").join(named(roots, "b", "y"), "b", "left")
    new = components(over.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    old = roots.join(named(new, "root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return stored(old.union(new.join(roots, "node", "left_anti").select("node", "root")), "roots")
