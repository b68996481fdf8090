"""Connected components of a graph given as pairs of longs, without gathering it anywhere.

Alternates the large-star and small-star steps of Kiveris et al. (2014): both
re-hang the neighbours of a vertex on its smallest one. Each step is a
grouped minimum and a join, edges never grow in number, and the number of
rounds is about the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.scratch import discard, written

_FEW_NAMES = 300_000  # of 16 bytes


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns ``a``, ``b``. Returns (node, root) for each vertex; root is the smallest id reachable.

    Self-loops and null ends are ignored; a vertex that has no other edge is not returned.
    Repeated edges do no harm. An empty input gives an empty result.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:  # ends: smallest neighbours only ever get smaller
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = written(small)
        state, before = _state(following), state
        discard(now)
        now = following
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def component_ids(roots: DataFrame, nodes: DataFrame, node: str, first_id: str) -> DataFrame:
    """(node, root, component_id): the smallest ``first_id`` of ``nodes`` in each component of ``roots``.

    One component may hold a large share of all vertices, so its row is brought to them: names are sent to every task if
    they are few, and else joined, where Spark splits what is skewed.
    """
    smallest = roots.join(nodes.select(F.col(node).alias("node"), first_id), "node").groupBy("root").agg(F.min(first_id).alias("component_id"))
    smallest = written(smallest)
    return roots.join(F.broadcast(smallest) if smallest.count() <= _FEW_NAMES else smallest, "root").select("node", "root", "component_id")
