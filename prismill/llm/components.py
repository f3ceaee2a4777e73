"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismill.session import durable


def components(links: DataFrame, rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of `links` (u, v): component is the smallest node reachable.

    Each round every node hooks to its smallest neighbour, pointers jump to their roots, and the graph is contracted to the
    links between roots. Of two linked nodes one hooks, so the roots of a round are a fraction of its nodes and there are
    about log n rounds, with about log n jumps each. Null ends and loops
    don't count. Nothing is collected; a hub is pre-aggregated by its minimum and its join is split as a skewed one. `rows` is
    about the number of links, if known.
    """
    left = durable(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), rows)
    labels, most = None, 0
    for _ in range(rounds):
        size = left.count()
        if not size:
            break
        most = max(most, 2 * size)  # nodes of a round, and of all
        both = left.select("u", "v").unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("up"))
        hook = durable(hook, 2 * size)
        # Pointers jump until every node points at its root: the depth halves each time.
        while True:
            above = hook.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            jumped = durable(hook.join(above, hook["up"] == above["n2"]).select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")), 2 * size)
            hook = jumped.select("node", "up")
            if not jumped.where("moved").head(1):
                break
        ends_u, ends_v = hook.select(F.col("node").alias("u"), F.col("up").alias("pu")), hook.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        moved = left.join(ends_u, "u").join(ends_v, "v").where("pu <> pv")
        left = durable(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), size)
        if labels is None:
            labels = hook.withColumnRenamed("up", "component")
        else:
            jump = hook.select(F.col("node").alias("component"), "up")
            labels = durable(labels.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")), most)
    else:
        raise RuntimeError("the components did not settle")
    return left.select(F.col("u").alias("node"), F.col("v").alias("component")) if labels is None else labels
