"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the component's smallest node.

    Each round sends every node to the smallest of its neighbours and itself, follows that map twice and contracts the
    links; at most half of the nodes remain, so rounds grow with the logarithm of the longest chain. Links of a
    hub are never brought together: only minima are, which are pre-aggregated.
    """
    e = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    whole: DataFrame | None = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("root")), "step")
        for _ in range(2):
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = written(step.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "step")
            forget(step)
            step = further
        ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if whole is None:
            new = step
        else:
            new = written(whole.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            forget(whole)
        left, right = (step.select(F.col("node").alias(c), F.col("root").alias(c + "2")) for c in "ab")
        moved = e.join(left, "a").join(right, "b").where("a2 <> b2")
        after = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        forget(e)
        if whole is not None:
            forget(step)
        e, whole = after, new
    return whole if whole is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
