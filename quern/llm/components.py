"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import stage


def _rank(node: Column, round_: int) -> Column:
    """Nodes in an order that is random and new in each round."""
    return F.struct(F.xxhash64(node, F.lit(round_)).alias("h"), node.alias("node"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the same root for all nodes that edges connect.

    Each round maps every node to the first of its neighbours and itself in a
    random order and goes on with the images only, so a constant share of the
    nodes goes each time, whatever the shape. A node with very many edges is
    combined before the shuffle when minima are taken, and its join partition
    is one that adaptive execution splits. Nodes without an edge (or with one
    to themselves only) and null nodes aren't in the result. The mapping of
    each round is a staged table; nothing but emptiness reaches the driver.
    """
    rest = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    maps: list[DataFrame] = []
    while True:
        rest = stage(rest.distinct(), "edges")
        if rest.isEmpty():
            break
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_rank(F.col("b"), len(maps))).alias("best"))
        image = F.least(F.col("best"), _rank(F.col("a"), len(maps)))["node"]
        maps.append(stage(first.select(F.col("a").alias("node"), image.alias("root")), "roots"))
        left = maps[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = rest.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        nxt = m.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage(out, "components")
