"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.session import stage


def _jumped(parents: DataFrame) -> DataFrame:
    """Every (c, p) with p replaced by the end of its chain of parents."""
    while True:
        above = parents.select(F.col("c").alias("p"), F.col("p").alias("above"))
        parents = stage(
            parents.drop("moved").join(above, "p", "left").select(
                "c", F.coalesce("above", "p").alias("p"), F.col("above").isNotNull().alias("moved")
            ),
            "parents",
        )
        if parents.filter("moved").isEmpty():
            return parents.select("c", "p")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) with the components of linked nodes (a, b) made one.

    Each component hooks onto its smallest neighbour, chains are shortened by jumping,
    and this is repeated on what is left, so that a round at least halves the components
    that still have links outside. Components are named by their smallest member.
    """
    while True:
        own = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        edges = stage(
            links.select("a", "b").join(own, "a").join(other, "b").filter("comp_a <> comp_b").select("comp_a", "comp_b"),
            "component-links",
        )
        if edges.isEmpty():
            return labels
        low, high = F.least("comp_a", "comp_b"), F.greatest("comp_a", "comp_b")
        hooks = stage(edges.groupBy(high.alias("c")).agg(F.min(low).alias("p")), "hooks")
        parents = _jumped(hooks)
        labels = stage(
            labels.join(parents.withColumnRenamed("c", "comp"), "comp", "left").select(
                "node", F.coalesce("p", "comp").alias("comp")
            ),
            "labels",
        )
