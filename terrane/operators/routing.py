"""Shortest paths by relaxation in rounds: nearest destination, k nearest, and reach within a budget.

State is a table of best distances by node. Each round joins the nodes that
improved (the frontier) with the edges that lead to them and keeps what got
shorter. Edges are written once, partitioned by head; state and frontier are
cut off by checkpoint() in the cluster's folder, so lost executors cost a round
at most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.cleaning import number
from terrane.functions.store import Rewritten, bucketed, cut
from terrane.operators.edges import graph_edges


#: Nodes still open, at most, that are broadcast to leave out messages to all others.
_FEW_OPEN = 1 << 17


def nearest_cost(edges: DataFrame, destinations: DataFrame, weights: Sequence[str], node: str = "node", by: Sequence[str] = ()) -> DataFrame:
    """(by, node, weights): least cost from each node to any destination, all weights at once; NULL where one cannot be reached.

    Edges are directed and run from u to v, so costs spread from v to u.
    `by` names variant columns of the edges that are routed apart (destinations
    are the same for all). Destinations that are no end of an edge are passed
    over; none at all is an error.

    Edges are written once, in buckets by head. Costs up to a limit are settled
    before the limit doubles, so an edge is followed about once and not each time
    that its head improves; at the end only edges of nodes that are still open are.
    """
    by, weights = list(by), list(weights)
    cost = {w: F.when(number(w) >= 0, number(w)).alias(w) for w in weights}
    known = lambda prefix="": F.coalesce(*(F.col(f"{prefix}{w}") for w in weights)).isNotNull()
    ends = edges.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *cost.values())
    graph, drop = bucketed(ends.where("u is not null and v is not null").where(known()), "v")
    goals = destinations.select(F.col(node).cast("long").alias("node")).where("node is not null").distinct()
    heads = graph.select(*by, F.col("v").alias("node")).join(goals, "node", "left_semi").select(*by, "node").distinct()
    nodes = graph.select(*by, F.col("u").alias("node")).distinct().union(heads).distinct()
    table = Rewritten("costs")
    first = nodes.join(goals.withColumn("_goal", F.lit(True)), "node", "left").select(*by, "node", *(F.when(F.col("_goal"), 0.0).alias(w) for w in weights), *(F.lit(False).alias(f"_new_{w}") for w in weights))
    state = table.write(first)
    if state.where(known()).isEmpty():
        drop()
        raise ValueError("no destination is on the network")
    new = F.greatest(*(F.col(f"_new_{w}") for w in weights)) if len(weights) > 1 else F.col(f"_new_{weights[0]}")
    mean = graph.agg(F.avg(F.coalesce(*weights))).first()[0]
    low, high = 0.0, mean / 4 if mean else math.inf
    few = None
    while True:
        for turn in itertools.count():
            # at first all nodes send what lies between the limits, then those that improved
            sent = {w: F.when(F.lit(turn == 0) | F.col(f"_new_{w}"), F.col(w)).alias(f"_{w}") for w in weights}
            step = state.where(known() if turn == 0 else new).select(*by, F.col("node").alias("v"), *sent.values())
            total = {w: F.col(f"_{w}") + F.col(w) for w in weights}
            within = {w: F.when((c < high) & (c >= (low if turn == 0 else 0.0)), c).alias(f"_{w}") for w, c in total.items()}
            met = graph.join(step.hint("shuffle_hash"), [*by, "v"]).select(*by, F.col("u").alias("node"), *within.values()).where(known("_"))
            met = met if few is None else met.join(F.broadcast(few), [*by, "node"], "left_semi")
            found = met.groupBy(*by, "node").agg(*(F.min(f"_{w}").alias(f"_{w}") for w in weights))
            better = {w: F.coalesce(F.col(f"_{w}") < F.col(w), F.col(f"_{w}").isNotNull()).alias(f"_new_{w}") for w in weights}
            state = table.write(state.join(found, [*by, "node"], "left").select(*by, "node", *(F.least(w, f"_{w}").alias(w) for w in weights), *better.values()))
            if state.where(new).isEmpty():
                break
        # costs under the limit are final; others may still fall or be found
        unsettled = F.lit(False)
        for w in weights:
            unsettled = unsettled | F.coalesce(F.col(w) >= high, F.lit(True))
        left = state.where(unsettled).select(*by, "node")
        n_left = left.limit(_FEW_OPEN + 1).count()
        if math.isinf(high) or n_left == 0:
            drop()
            return state.where(known()).select(*by, "node", *weights)
        few = cut(left) if n_left <= _FEW_OPEN else None
        low, high = high, 2 * high if turn else math.inf  # a limit that changed nothing: what is left is far or cut off


def k_nearest_cost(edges: DataFrame, destinations: DataFrame, weight: str, k: int, node: str = "node") -> DataFrame:
    """(node, n_found, mean_cost): mean cost to the k nearest distinct destinations; NULL where there are fewer."""
    graph = cut(graph_edges(edges, [weight]).where(F.col(weight).isNotNull()).repartition("v"))
    ends = graph.select(F.col("u").alias("node")).union(graph.select("v")).distinct()
    goals = destinations.select(F.col(node).cast("long").alias("node")).distinct()
    state = cut(ends.join(goals, "node", "left_semi").select("node", F.col("node").alias("goal"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")))
    place = Window.partitionBy("node").orderBy("cost", "goal")
    while True:
        step = state.where("fresh").select(F.col("node").alias("v"), "goal", "cost")
        found = graph.join(step, "v").groupBy(F.col("u").alias("node"), "goal").agg(F.min(F.col("cost") + F.col(weight)).alias("cost"))
        both = state.select("node", "goal", "cost", F.lit(False).alias("fresh")).union(found.select("node", "goal", "cost", F.lit(True)))
        # of equal costs the known label wins, so it counts as no change
        best = both.groupBy("node", "goal").agg(F.min(F.struct("cost", "fresh")).alias("x")).select("node", "goal", "x.*")
        state = cut(best.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place"))
        if state.where("fresh").isEmpty():
            return state.groupBy("node").agg(F.count("*").alias("n_found"), F.when(F.count("*") >= k, F.avg("cost")).alias("mean_cost"))


def reach_within(edges: DataFrame, sources: DataFrame, weight: str, budget: float, node: str = "node") -> DataFrame:
    """(source, node, cost): nodes that each source reaches along the edges within the budget, itself included."""
    graph = cut(graph_edges(edges, [weight]).where(F.col(weight) <= budget).repartition("u"))
    state = cut(sources.select(F.col(node).cast("long").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")))
    while True:
        step = state.where("fresh").select("source", F.col("node").alias("u"), "cost")
        found = graph.join(step, "u").select("source", F.col("v").alias("node"), (F.col("cost") + F.col(weight)).alias("cost")).where(F.col("cost") <= budget)
        both = state.select("source", "node", "cost", F.lit(False).alias("fresh")).union(found.withColumn("fresh", F.lit(True)))
        state = cut(both.groupBy("source", "node").agg(F.min(F.struct("cost", "fresh")).alias("x")).select("source", "node", "x.*"))
        if state.where("fresh").isEmpty():
            return state.select("source", "node", "cost")


def reach_shrink(edges: DataFrame, sources: DataFrame, budget: float = 400.0, flat: str = "cost_m0", hard: str = "cost_m3") -> DataFrame:
    """(source, n_flat, n_hard, shrink): nodes reached under two weights and their ratio, the lowest first."""
    count = lambda w, name: reach_within(edges, sources, w, budget).groupBy("source").agg(F.count("*").alias(name))
    both = count(flat, "n_flat").join(count(hard, "n_hard"), "source")
    return both.withColumn("shrink", F.col("n_hard") / F.col("n_flat"))


def leading_stop(shrink: DataFrame, steepness: DataFrame, least_flat: int = 120, steepest: int = 250) -> DataFrame:
    """One row: of the steepest sources (a top-k report, ties by id) that reach enough nodes on the flat the one whose reach shrinks most."""
    steep = steepness.select(F.col("node").alias("source"), F.coalesce("steepness", F.lit(0.0)).alias("steepness"))
    first = shrink.join(steep, "source", "left").fillna(0.0, subset=["steepness"]).orderBy(F.desc("steepness"), "source").limit(steepest)
    return first.where(F.col("n_flat") >= least_flat).orderBy("shrink", F.desc("steepness"), "source").limit(1)


def reach_gaps(nodes: DataFrame, edges: DataFrame, sources: DataFrame, budget: float = 400.0, flat: str = "cost_m0", hard: str = "cost_m3") -> DataFrame:
    """(source, node, gap) for the nodes (node_id, x, y) within the budget as the crow flies: "detour" if streets are too long, "slope" if only the harder cost is, else "reached".

    The walkshed's parts as sets of nodes: circle without flat reach, flat reach without hard reach.
    Edges may have the straight `distance` of their ends; else it is looked up in the nodes.
    Sources whose direct streets lead to all that any way could reach are not routed.
    """
    from terrane.operators.spatial import within_distance

    starts = sources.select(F.col("node").cast("long").alias("source")).distinct().join(nodes.select(F.col("node_id").alias("source"), "x", "y"), "source")
    there = nodes.select(F.col("node_id").alias("node"), "x", "y")
    radii, known = _one_hop(nodes, edges, starts, there, (flat, hard), budget)
    near = within_distance(starts.join(known.where("_whole"), "source", "left_semi"), there, budget)
    gap = F.when((F.col("source") == F.col("node")) | (F.col("distance") <= radii[hard]), "reached").when(F.col("distance") <= radii[flat], "slope").otherwise("detour")
    direct = near.select("source", "node", gap.alias("gap"))
    rest = known.where("not _whole").select("source")
    if rest.isEmpty():
        return direct
    circle = within_distance(starts.join(rest, "source", "left_semi"), there, budget).select("source", "node")
    reached = lambda w, name: reach_within(edges, rest, w, budget, "source").select("source", "node", F.lit(True).alias(name))
    both = circle.join(reached(flat, "_flat"), ["source", "node"], "left").join(reached(hard, "_hard"), ["source", "node"], "left")
    gap = F.when(F.col("_hard").isNotNull(), "reached").when(F.col("_flat").isNotNull(), "slope").otherwise("detour")
    return direct.union(both.select("source", "node", gap.alias("gap")))


def _one_hop(nodes: DataFrame, edges: DataFrame, starts: DataFrame, there: DataFrame, weights: Sequence[str], budget: float) -> tuple[dict[str, float], DataFrame]:
    """Radius of each weight, and (source, _whole): whether its direct edges lead to all nodes in each radius.

    If no edge costs less than c times the straight distance of its ends, no way
    does, so none within the budget leaves the circle of budget / c. A source
    that has an edge to every node in there reaches these and no others. The two
    sets are compared by size and 128 bits of hashes, so no pair is shuffled;
    parallel edges make them differ, and the source is routed.
    """
    from terrane.operators.spatial import within_distance

    if "distance" not in edges.columns:
        for end in "uv":
            edges = edges.join(nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"_{end}x"), F.col("y").alias(f"_{end}y")), end, "left")
        edges = edges.withColumn("distance", F.hypot(F.col("_ux") - F.col("_vx"), F.col("_uy") - F.col("_vy")))

    def prints(node: str, name: str, test: Column) -> list[Column]:
        bits = [F.coalesce(F.bit_xor(F.when(test, F.xxhash64(node, F.lit(k)))), F.lit(0)).alias(f"{name}{k}") for k in range(2)]
        return [F.count_if(test).alias(f"{name}n"), *bits]

    cost = {w: F.when(number(w) <= budget, number(w)) for w in weights}
    ways = edges.select(F.col("u").cast("long").alias("source"), F.col("v").cast("long").alias("node"), "distance", *(F.when(c >= 0, c).alias(w) for w, c in cost.items()))
    ways = ways.where("source is not null and node is not null and source != node")
    share = lambda w: F.when(F.col(w).isNotNull() & ~F.coalesce(F.col("distance") == 0, F.lit(False)), F.coalesce(F.try_divide(w, "distance"), F.lit(0.0)))
    out = cut(ways.groupBy("source").agg(*(c for w in weights for c in (F.min(share(w)).alias(f"_{w}"), *prints("node", f"_{w}_out", F.col(w).isNotNull())))))
    least = out.agg(*(F.min(f"_{w}").alias(w) for w in weights)).first()
    # without a usable edge nothing but what stands at the source's place is in reach
    radii = {w: 0.0 if c is None else budget / c * (1 + 1e-9) if c > 0 else float("inf") for w, c in least.asDict().items()}
    widest = max(budget, *radii.values())
    if widest > 2 * budget:  # costs that far under the straight distance bound nothing
        return radii, starts.select("source", F.lit(False).alias("_whole"))
    near = within_distance(starts, there, widest).where("source != node")
    inside = near.groupBy("source").agg(*(c for w in weights for c in prints("node", f"_{w}_in", F.col("distance") <= radii[w])))
    pairs = [(f"_{w}_out{k}", f"_{w}_in{k}") for w in weights for k in ("n", "0", "1")]
    both = starts.select("source").join(out, "source", "left").join(inside, "source", "left").fillna(0, subset=[c for p in pairs for c in p])
    whole = F.lit(True)
    for a, b in pairs:
        whole = whole & (F.col(a) == F.col(b))
    return radii, cut(both.select("source", whole.alias("_whole")))


def cell_access(cells: DataFrame, origins: DataFrame, costs: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Cells with access_<weight> of their origin node and <weight>_reachable; cells without a node stay, with NULL.

    origins: hex_id, origin_node_id, snap_distance_m. Snap distance is no part of the cost.
    """
    named = costs.select(F.col("node").alias("origin_node_id"), *(F.col(w).alias(f"access_{w}") for w in weights))
    joined = cells.join(origins, "hex_id", "left").join(named, "origin_node_id", "left")
    return joined.withColumns({f"{w}_reachable": F.col(f"access_{w}").isNotNull() for w in weights})
