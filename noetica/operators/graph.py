"""Graph operators: components, closures and shortest paths on edge tables; flows, matchings
and Dijkstra on the small graphs of one group."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved, saved_with_count, saved_with_state


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected edge table ``(src, dst)``; the least node names it.

    Large-star and small-star rounds: their number grows with the logarithm of the size.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now, last = saved_with_state(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components", ["u", "v"])
    while last[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        now, new = saved_with_state(small, "components", ["u", "v"])
        if new == last:
            break
        last = new
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All ``(src, dst)`` joined by one edge or more; ends on cycles.

    A round joins the pairs that the last one found with all pairs known, so it doubles the
    length of the paths covered: rounds grow with the logarithm of the longest shortest path.
    """
    known = frontier = saved(edges.select("src", "dst").distinct(), "closure")
    while not frontier.isEmpty():
        step = known.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        reached = frontier.join(step, "dst").select("src", F.col("_next").alias("dst")).distinct()
        frontier = saved(reached.join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.unionByName(frontier)
    return known


#: Rounds after which ``reachable`` goes over to the doubling closure.
SINGLE_ROUNDS = 8


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pairs ``(src, dst)`` of the closure that start in ``seeds.node``.

    The frontier moves by one edge a round, so only what the seeds reach is touched.  Where
    paths are longer than SINGLE_ROUNDS, the nodes left are joined to the doubling closure.
    """
    edges = saved(edges.select("src", "dst").distinct(), "edges")
    start = seeds.select("node").distinct()
    known = frontier = saved(edges.join(start, edges["src"] == start["node"], "left_semi"), "reached")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    rounds = 0
    while not frontier.isEmpty():
        if rounds == SINGLE_ROUNDS:
            ends = frontier.select("dst").distinct()
            step = transitive_closure(edges).join(ends, F.col("src") == ends["dst"], "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        reached = frontier.join(step, "dst").select("src", F.col("_next").alias("dst")).distinct()
        frontier = saved(reached.join(known, ["src", "dst"], "left_anti"), "reached")
        known = known.unionByName(frontier)
        if rounds == SINGLE_ROUNDS:
            break
        rounds += 1
    return known


#: Blocks in which ``all_pairs`` deals its right side.
BLOCKS = 64


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``: what a query without a common variable
    asks for.  The right side is dealt into blocks and the left side sent to each, an
    equi-join on the block; the smaller side should be the left one."""
    blocks = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in right.columns]), F.lit(BLOCKS)).cast("int"))
    return blocks.join(dealt, "_block").drop("_block")


#: Rows up to which a frontier is sent to all tasks; whatever is larger, or not counted, is shuffled.
#: Tables are not left to Spark's own guess here: by the size of compressed files it sends millions
#: of rows through the driver.
SENT_ROWS = 20_000


def _stepped(frontier: DataFrame, n: int, table: DataFrame, on: list[str] | str) -> DataFrame:
    """A join of ``n`` frontier rows with a table of any size, which is never sent around."""
    return F.broadcast(frontier).join(table, on) if n <= SENT_ROWS else frontier.join(table.hint("merge"), on)


def shortest_paths(edges: DataFrame, sources: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``(source, node, distance, parent)`` from each ``sources.node``; weights ``w`` are not negative.

    Where ``sources`` has a column ``source``, nodes that share it are one source together.

    Frontier relaxation: a round only follows nodes whose distance just fell.  Of equal
    distances the smaller parent stays.
    """
    name = F.col("source" if "source" in sources.columns else "node").alias("source")
    best = saved(sources.select(name, "node", F.lit(0.0).alias("distance"), F.lit(None).cast(sources.schema["node"].dataType).alias("parent")).distinct(), "paths")
    frontier, n = best, best.count()
    while n:
        reached = _stepped(frontier, n, edges.select(F.col("src").alias("node"), "dst", F.col("w").cast("double").alias("w")), "node")
        reached = reached.select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("d"), F.col("node").alias("p"))
        if max_distance is not None:
            reached = reached.where(F.col("d") <= max_distance)
        reached = reached.groupBy("source", "node").agg(F.min(F.struct("d", "p")).alias("new"))
        both = best.join(reached.hint("merge"), ["source", "node"], "full_outer").withColumn("fell", F.col("new.d").isNotNull() & (F.col("distance").isNull() | (F.col("new.d") < F.col("distance"))))
        both, n = saved_with_count(both.select("source", "node", F.when(F.col("fell"), F.col("new.d")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("fell"), F.col("new.p")).otherwise(F.col("parent")).alias("parent"), "fell"), "paths", "fell")
        best, frontier = both.drop("fell"), both.where("fell").drop("fell")
    return best


def settled_at(paths: DataFrame, stops: DataFrame) -> DataFrame:
    """Of ``shortest_paths`` what a search that ends at its first stop has settled.

    ``stops``: (source, node), any number of nodes for a source.  Of each source the nodes stay
    that are no farther than its nearest stop; sources that meet none keep all of theirs.
    """
    nearest = paths.join(stops.select("source", "node").distinct(), ["source", "node"]).groupBy("source").agg(F.min("distance").alias("_stop"))
    return paths.join(nearest, "source", "left").where("_stop is null or distance <= _stop").drop("_stop")


def path_nodes(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, node, path``: the nodes from the source to each of ``targets(source, node)``.

    Paths are unfolded from their ends by the parents of ``shortest_paths``, all at once.
    """
    step = paths.select("source", F.col("node").alias("_at"), F.col("parent").alias("_up"))
    walks = saved(targets.join(paths.select("source", "node").hint("merge"), ["source", "node"]).select("source", "node", F.col("node").alias("_at"), F.array("node").alias("path")), "walks")
    done = None
    while n := walks.count():
        moved = _stepped(walks, n, step, ["source", "_at"])
        ended = moved.where("_up is null").select("source", "node", "path")
        done = ended if done is None else done.unionByName(ended)
        walks = saved(moved.where("_up is not null").select("source", "node", F.col("_up").alias("_at"), F.concat(F.array("_up"), "path").alias("path")), "walks")
    return done if done is not None else walks.select("source", "node", "path")


def joined_paths(first: Column, second: Column) -> Column:
    """Two paths in a row; null unless the second begins where the first ends."""
    return F.when(F.element_at(first, -1) == F.get(second, 0), F.concat(first, F.slice(second, 2, F.greatest(F.size(second) - 1, F.lit(0)))))


def path_head(path: Column, n: int) -> Column:
    return F.slice(path, 1, n)


def path_tail(path: Column, n: int) -> Column:
    """The path without its first ``n`` nodes."""
    return F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0)))


# -- small graphs, inside a task


def dijkstra(neighbours: Callable[[Hashable], Iterable[tuple[float, Hashable]]], sources: Iterable[Hashable], targets: Callable[[Hashable], bool] | None = None, heuristic: Callable[[Hashable], float] = lambda _: 0.0, max_distance: float = float("inf")):
    """Distances and parents; stops at the first target.  With a heuristic this is A*."""
    distance, parent, done, queue = {}, {}, set(), []
    for s in sources:
        distance[s] = 0.0
        heapq.heappush(queue, (heuristic(s), len(queue), s))
    count = len(queue)
    while queue:
        _, _, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        if targets and targets(u):
            return distance, parent, u
        for w, v in neighbours(u):
            d = distance[u] + w
            if d <= max_distance and d < distance.get(v, float("inf")):
                distance[v], parent[v] = d, u
                count += 1
                heapq.heappush(queue, (d + heuristic(v), count, v))
    return distance, parent, None


def path_to(parent: dict, node: Hashable) -> list:
    out = [node]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out[::-1]


def assignment(cost: np.ndarray) -> list[int]:
    """Row by row the column of a cheapest one-to-one assignment, -1 for rows left over."""
    rows, columns = cost.shape
    if rows == 0 or columns == 0:
        return [-1] * rows
    if rows > columns:
        out = [-1] * rows
        for c, r in enumerate(assignment(cost.T)):
            out[r] = c
        return out
    u, v, owner = np.zeros(rows + 1), np.zeros(columns + 1), np.zeros(columns + 1, int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        slack, back, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, int), np.zeros(columns + 1, bool)
        while True:
            used[at] = True
            free = ~used[1:]
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = free & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], at
            to = 1 + int(np.argmin(np.where(free, slack[1:], np.inf)))
            delta = slack[to]
            u[owner[used]] += delta
            v[used] -= delta
            slack[1:][free] -= delta
            at = to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [-1] * rows
    for c in range(1, columns + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def min_cost_flow(edges: list[tuple[Hashable, Hashable, float, float]], source: Hashable, sink: Hashable) -> tuple[float, float, dict]:
    """Greatest flow of least cost: (flow, cost, flow by edge); successive shortest paths."""
    graph: dict = {}
    for k, (a, b, capacity, cost) in enumerate(edges):
        forth, back = [b, capacity, cost, None, k], [a, 0.0, -cost, None, -1]
        forth[3], back[3] = back, forth
        graph.setdefault(a, []).append(forth)
        graph.setdefault(b, []).append(back)
    potential = dict.fromkeys(graph, 0.0)
    total = cost = 0.0
    while True:
        distance, via, queue, tick = {source: 0.0}, {}, [(0.0, 0, source)], 0
        while queue:
            d, _, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for e in graph.get(a, ()):
                if e[1] > 1e-12:
                    new = d + e[2] + potential[a] - potential[e[0]]
                    if new < distance.get(e[0], float("inf")) - 1e-12:
                        distance[e[0]], via[e[0]] = new, (a, e)
                        tick += 1
                        heapq.heappush(queue, (new, tick, e[0]))
        if sink not in distance or sink == source:
            break
        for node, d in distance.items():
            potential[node] += d
        room, node = float("inf"), sink
        while node != source:
            node, e = via[node]
            room = min(room, e[1])
        node = sink
        while node != source:
            node, e = via[node]
            e[1] -= room
            e[3][1] += room
            cost += room * e[2]
        total += room
    flows = {}
    for a, own in graph.items():
        for e in own:
            if e[4] >= 0:
                flows[(a, e[0])] = flows.get((a, e[0]), 0.0) + e[3][1]
    return total, cost, flows
