"""Graphs of areas as edge tables (src, dst), in both directions unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.plans.session import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))


def client_graph(edges: DataFrame, occupied: DataFrame, allowance: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges between occupied areas that a path over at most `allowance` empty areas connects.

    occupied: keys and pcode. A step for each empty area, each a join with distinct ends, so cycles
    do not multiply rows; a path never goes on from an occupied area."""
    own = list(keys)
    start = occupied.select(*own, F.col("pcode").alias("src"))
    ends = occupied.select(*own, F.col("pcode").alias("dst"), F.lit(True).alias("_full"))
    reached = start.join(edges, "src").select(*own, "src", "dst").join(ends, [*own, "dst"], "left")
    found = [reached.filter("_full")]
    for _ in range(allowance):
        empty = reached.filter(F.col("_full").isNull()).select(*own, "src", F.col("dst").alias("_via"))
        onward = edges.select(F.col("src").alias("_via"), "dst")
        reached = empty.join(onward, "_via").select(*own, "src", "dst").distinct().join(ends, [*own, "dst"], "left")
        found.append(reached.filter("_full"))
    every = reduce(DataFrame.unionByName, found).filter("src <> dst").select(*own, "src", "dst")
    return undirected(every).distinct()


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node and component, the smallest node that edges lead to.

    Labels spread along edges and jump to their label's label, so long paths take few rounds; each
    round is checkpointed, and they go on until no label changes."""
    own = list(keys)
    edges = checkpointed(edges.select(*own, "src", "dst"))
    state = checkpointed(nodes.select(*own, F.col("node"), F.col("node").alias("component")))
    while True:
        spread = edges.join(state.select(*own, F.col("node").alias("dst"), F.col("component").alias("_c")), [*own, "dst"])
        low = spread.groupBy(*own, F.col("src").alias("node")).agg(F.min("_c").alias("_low"))
        hooked = state.join(low, [*own, "node"], "left").withColumn("_new", F.least("component", F.coalesce("_low", "component")))
        target = hooked.select(*own, F.col("node").alias("_new"), F.col("_new").alias("_jump"))
        moved = hooked.join(target, [*own, "_new"], "left").select(
            *own, "node", F.least("_new", F.coalesce("_jump", "_new")).alias("component"), F.col("component").alias("_was")
        )
        state = checkpointed(moved)
        if state.filter("component <> _was").isEmpty():
            break
        state = state.drop("_was")
    return state.select(*own, "node", "component")


def quotient(edges: DataFrame, zones: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Which zones touch: distinct pairs of zones whose areas have an edge (edges have the keys too)."""
    own = list(keys)
    a = zones.select(*own, F.col("pcode").alias("src"), F.col("zone").alias("a"))
    b = zones.select(*own, F.col("pcode").alias("dst"), F.col("zone").alias("b"))
    return edges.join(a, [*own, "src"]).join(b, [*own, "dst"]).filter("a <> b").select(*own, "a", "b").distinct()


def boundary(edges: DataFrame, zones: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Areas of a zone that touch another one, with that zone and their number of clients."""
    own = list(keys)
    a = zones.select(*own, F.col("pcode").alias("src"), F.col("zone").alias("zone"))
    b = zones.select(*own, F.col("pcode").alias("dst"), F.col("zone").alias("other"))
    met = edges.join(a, "src").join(b, [*own, "dst"]).filter("zone <> other").select(*own, "zone", "other", F.col("src").alias("pcode")).distinct()
    return met.join(counts, [*own, "pcode"], "left").withColumn("n_clients", F.coalesce("n_clients", F.lit(0)))


def degrees(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    own = list(keys)
    counted = edges.groupBy(*own, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.join(counted, [*own, "node"], "left").select(*own, "node", F.coalesce("_n", F.lit(0)).alias("degree"))


def degree_stats(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Connected and isolated nodes, smallest, largest and mean degree."""
    return degrees(nodes, edges, keys).groupBy(*keys).agg(
        F.sum((F.col("degree") > 0).cast("long")).alias("connected"), F.sum((F.col("degree") == 0).cast("long")).alias("isolated"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"),
    )


def ancestors(tree: DataFrame) -> DataFrame:
    """node, ancestor and distance for every node of a tree (node, parent), itself included. Paths
    double each round, until none is new: as many joins as the depth's logarithm."""
    step = checkpointed(tree.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = step
    while True:
        far = step.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_far"), F.col("distance").alias("_d"))
        longer = reach.join(far, reach["ancestor"] == far["_mid"]).select("node", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        fresh = checkpointed(longer.join(reach.select("node", "ancestor"), ["node", "ancestor"], "left_anti").distinct())
        if fresh.isEmpty():
            break
        reach = checkpointed(reach.unionByName(fresh))
        step = reach
    return reach.unionByName(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))


def relevant(tree: DataFrame, occupied: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Occupied nodes (keys and pcode) and all above them."""
    held = occupied.select(*keys, F.col("pcode").alias("node"))
    return ancestors(tree).join(held, "node").select(*keys, F.col("ancestor").alias("node")).distinct()


def subtree_counts(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """Clients at or below each node."""
    held = ancestors(tree).join(counts.select(F.col("pcode").alias("node"), "n_clients"), "node", "left")
    return held.groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("n_clients"), F.lit(0)).alias("n_clients"))


def children(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("children"))


def similarity_graph(similarities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges i, j of route pairs more alike than the threshold."""
    return similarities.filter(F.col("similarity") > threshold)
