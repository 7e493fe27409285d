"""Connected components of links, as Spark jobs.

Every round hooks each node to the smallest label among its neighbours and halves the paths (a node takes the
label of its label). Rounds end when no label changes. Edges stay a table, labels are written after every
round; nothing is collected. Hot nodes are no trouble: minima are taken before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the smallest node that can be reached.

    Null ends are left out; loops and repeated edges do no harm.
    """
    clean = edges.where("a is not null and b is not null").select("a", "b")
    both = written(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        stepped = written(hooked, "hooked")
        # what the members of a label have found becomes known to all who carry the label
        roots = stepped.groupBy("old").agg(F.min("component").alias("found"))
        jumped = written(
            stepped.join(roots.withColumnRenamed("old", "root"), F.col("component") == F.col("root"), "left")
            .select("node", "old", F.least("component", F.coalesce("found", "component")).alias("component")), "labels")
        changed = jumped.where("old <> component").limit(1).count()
        forget(labels, stepped)
        labels = jumped.select("node", "component")
        labels._written_to = jumped._written_to
        if not changed:
            forget(both)
            return labels
