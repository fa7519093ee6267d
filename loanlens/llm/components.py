"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.session import materialize


def _rows(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, smaller end first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (a node of its component) of every node in ``edges (a, b)``.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by pointer
    jumping, and contracts the edges. Only nodes without smaller neighbours survive a round, at most half
    of them. All tables stay distributed; each step is written, so a lost executor costs one step.
    Null ends are ignored; an empty table gives an empty result. Not for labels: ``component`` is constant
    within a component but need not be its smallest node.
    """
    edges = materialize(_rows(edges), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        hooks = ends.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = materialize(hooks.join(up, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooks")
            hooks = jumped.select("a", "to")
            if jumped.where("moved").isEmpty():
                break
        if first:
            labels, first = hooks.select(F.col("a").alias("node"), F.col("to").alias("component")), False
        else:
            up = hooks.select(F.col("a").alias("component"), "to")
            labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left, right = hooks.select("a", F.col("to").alias("x")), hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = materialize(_rows(edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    return labels
