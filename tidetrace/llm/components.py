"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node reachable from each node of ``links``.

    Each round hooks every node to its smallest neighbour and contracts the links
    by it; links inside one contracted node vanish. The rounds' hooks are composed
    at the end. A hub needs no list of its neighbours: its minimum is a partial
    aggregate. Nodes without links are not returned. Empty links give no rows.
    """
    edges = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    kind = edges.schema["a"].dataType.simpleString()
    hooks = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                     .select("node", F.least("node", "least").alias("root")))
        hooks.append(hook)
        # Merge joins: a broadcast takes 16 MB of the driver's heap at least, and there are many rounds.
        ha = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")).hint("merge")
        hb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb")).hint("merge")
        edges = stage(edges.join(ha, "a").join(hb, "b").filter("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not hooks:
        return edges.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    # From the last round back: what a round's hook points at may be hooked further.
    # A contracted node that lost its last link keeps the hook it had; chains end here.
    roots = hooks.pop()
    while hooks:
        hook, nxt = hooks.pop(), roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        roots = stage(hook.join(nxt.hint("merge"), "root", "left")
                      .select("node", F.coalesce("further", "root").alias("root")))
    return roots
