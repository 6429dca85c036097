"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.session import store


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the undirected links ``a``, ``b`` reaches.

    Every round, each node points to its smallest neighbour if that is smaller than itself, pointers are followed to
    their ends, and the links are drawn anew between the ends: links inside a part that has become one node go, equal ones
    merge, so later rounds are small. The smallest node of a component never moves. Every step is a written table:
    nothing is gathered in one task or on the driver, and lost executors repeat one step at most. Rows with a missing
    end and self-links are left out.
    """
    ends = links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = store(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = None
    while True:
        ups = followed(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
        labels = ups if labels is None else composed(labels, ups)
        ends = edges.join(ups, "node").join(ups.select(F.col("node").alias("other"), F.col("component").alias("to")), "other")
        edges = store(ends.where("component <> to").select(F.col("component").alias("node"), F.col("to").alias("other")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels


def followed(pointers: DataFrame) -> DataFrame:
    """(node, component): pointers to smaller nodes, each replaced by its target's own until all are at their ends."""
    found = store(pointers, "pointers")
    while True:
        after = found.select(F.col("node").alias("at"), F.col("component").alias("next"))
        jumped = store(found.join(after, F.col("component") == F.col("at")).select("node", F.col("next").alias("component"), F.col("component").alias("was")), "pointers")
        found = jumped.select("node", "component")
        if not jumped.where("component <> was").limit(1).count():
            return found


def composed(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` with each component replaced by what it is in ``more``, where that has it."""
    step = more.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return store(labels.join(step, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
