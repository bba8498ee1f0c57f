"""Connected components by hooking to the smallest neighbour, pointer jumping and contraction.

Every round is written to the shared folder, which cuts the lineage: a lost executor costs a task of the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import staged


def jump(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) with parent < node, by doubling the step until nothing moves."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        moved = staged(
            parents.join(above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")),
            "jump",
        )
        parents = moved.select("node", "parent")
        if moved.where("moved").limit(1).count() == 0:
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b) that are not themselves the smallest of their component."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    found = None
    while edges.limit(1).count():
        # Every node but a local minimum hooks on to its smallest neighbour.
        forest = jump(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        found = forest if found is None else staged(_compose(found, forest), "roots")
        a, b = (forest.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        edges = staged(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _compose(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roots after a further round: old roots may have got roots themselves, and so may nodes that were roots."""
    up = new.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    raised = old.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return raised.unionAll(new)


def resolve(nodes: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """Add column `name`: the root of `column`, or itself."""
    up = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return nodes.join(up, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")
