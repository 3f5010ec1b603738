"""Graph operators that iterate: components, distances, eigenvector, cores, bridges. Each round's state is written, so lineage stays short."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import dice
from nodeloom.operators import csr
from nodeloom.operators.graph import adjacency, degrees
from nodeloom.operators.store import joined_to_keys, released, stored


def _by_place(spark, graph: csr.Csr, name: str, values: np.ndarray) -> DataFrame:
    """``(person_id, name)`` with the value of each place."""
    return spark.createDataFrame(pa.table({"person_id": pa.array(graph.ids, pa.int64()), name: pa.array(values)}))


def connected_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(person_id, component)``: the smallest id that a node reaches.

    Nodes take their neighbourhood's smallest label, then the label of that label, so a label's way doubles each round.
    A graph of numbered nodes within csr's bounds is solved as arrays.
    """
    graph = csr.compact(vertices, edges) if dict(vertices.dtypes)["person_id"] in ("bigint", "int") else None
    if graph is not None:
        return _by_place(vertices.sparkSession, graph, "component", graph.ids[csr.components(graph)])
    adj = adjacency(edges)
    kept = now = stored(vertices.select("person_id", F.col("person_id").alias("component")))
    for _ in range(most_rounds):
        low = adj.join(now, adj["dst"] == now["person_id"]).groupBy(F.col("src").alias("person_id")).agg(F.min("component").alias("low"))
        step = now.join(low, "person_id", "left").select("person_id", F.col("component").alias("before"), F.least("component", F.coalesce("low", "component")).alias("component"))
        step = stored(step)
        # many nodes have one label: how far each label leads is found once for it and sent to its nodes where they are many
        used = step.groupBy("component").agg(F.count("*").alias("n"))
        further = stored(used.join(step.select(F.col("person_id").alias("component"), F.col("component").alias("further")), "component", "left"))
        after = stored(joined_to_keys(step, further, "component", "n", step.count()).select("person_id", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        done = after.where("before <> component").isEmpty()
        for old in (step, further, kept):
            released(old)
        kept, now = after, after.select("person_id", "component")
        if done:
            return now
    raise RuntimeError(f"connected_components: no fixpoint after {most_rounds} rounds")


def bfs(edges: DataFrame, sources: DataFrame, cutoff: int | None = None) -> DataFrame:
    """``(src, node, d)``: distances from each source (person_id), up to ``cutoff`` hops, sources at 0."""
    adj = adjacency(edges).withColumnRenamed("src", "node")
    front = stored(sources.select(F.col("person_id").alias("src"), F.col("person_id").alias("node"), F.lit(0).alias("d")))
    levels, seen, d = front, front, 0
    while cutoff is None or d < cutoff:
        d += 1
        reached = front.join(adj, "node").select("src", F.col("dst").alias("node")).distinct()
        # a neighbour of a level lies in that level, the one before or the next
        front = stored(reached.join(seen, ["src", "node"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        seen = levels.where(F.col("d") == d - 1).unionByName(front)
        levels = levels.unionByName(front)
    return levels


def shortest_path_flow(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(person_id, dependency, load)``: sums over the sources of Brandes' dependency and of Newman's load.

    Level by level: forward, path counts add up over predecessors; backward, a node hands its share to them, in
    proportion to their path counts (dependency) or evenly (load). Both parts of a pair are counted, as the graph is
    undirected; a source counts nothing for itself.
    """
    adj = stored(adjacency(edges)).withColumnRenamed("src", "node")
    front = stored(sources.select(F.col("person_id").alias("src"), F.col("person_id").alias("node"), F.lit(1.0).alias("sigma")))
    levels, before = [front], None
    while True:
        ways = front.join(adj, "node").groupBy("src", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"), F.count("*").alias("preds"))
        ways = ways.join(front, ["src", "node"], "left_anti")
        if before is not None:
            ways = ways.join(before, ["src", "node"], "left_anti")
        ways = stored(ways)
        if ways.isEmpty():
            break
        before, front = front.select("src", "node"), ways
        levels.append(ways)
    flow, total = None, None
    for depth in range(len(levels) - 1, 0, -1):
        own = levels[depth]
        if flow is None:
            own = own.withColumns({"delta": F.lit(0.0), "packets": F.lit(0.0)})
        else:
            own = own.join(flow, ["src", "node"], "left").na.fill(0.0, ["delta", "packets"])
        part = own.select("node", F.col("delta"), F.col("packets"))
        total = part if total is None else total.unionByName(part)
        share = own.join(adj, "node").select("src", F.col("dst").alias("node"), ((1 + F.col("delta")) / F.col("sigma")).alias("x"), ((1 + F.col("packets")) / F.col("preds")).alias("y"))
        above = levels[depth - 1].select("src", "node", "sigma")
        flow = stored(share.join(above, ["src", "node"]).groupBy("src", "node").agg((F.sum("x") * F.first("sigma")).alias("delta"), F.sum("y").alias("packets")))
    if total is None:
        return sources.select("person_id").where("false").withColumns({"dependency": F.lit(0.0), "load": F.lit(0.0)})
    return total.groupBy(F.col("node").alias("person_id")).agg(F.sum("delta").alias("dependency"), F.sum("packets").alias("load"))


def eigenvector(vertices: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, most_rounds: int = 1000) -> DataFrame:
    """``(person_id, eigenvector)``: power iteration x <- x + A x with length 1, until the change is under n * tolerance, or for ``rounds``.

    Without edges all entries stay equal. No convergence is an error. A graph within csr's bounds is iterated as arrays.
    """
    graph = csr.compact(vertices, edges)
    spark = vertices.sparkSession
    if graph is not None:
        return csr.in_task(spark, graph, "person_id long, eigenvector double", lambda g: [g.ids, csr.eigenvector(g, rounds, tolerance, most_rounds)])
    adj = stored(adjacency(edges))
    n = vertices.count()
    now, scale = stored(vertices.select("person_id", F.lit(1.0 / max(1, n)).alias("y"), F.lit(0.0).alias("before"))), 1.0
    for _ in range(rounds if rounds is not None else most_rounds):
        x = now.select("person_id", (F.col("y") * scale).alias("before"))
        sums = adj.join(x, adj["dst"] == x["person_id"]).groupBy(F.col("src").alias("person_id")).agg(F.sum("before").alias("s"))
        after = stored(x.join(sums, "person_id", "left").select("person_id", "before", (F.col("before") + F.coalesce("s", F.lit(0.0))).alias("y")))
        # the length goes into the next round's reading, so a round is written once
        length = after.agg(F.coalesce(F.sqrt(F.sum(F.col("y") * F.col("y"))), F.lit(0.0)).alias("l")).first()["l"]
        released(now)
        now, scale = after, 1.0 / (length or 1.0)
        if rounds is None and now.agg(F.coalesce(F.sum(F.abs(F.col("y") * scale - F.col("before"))), F.lit(0.0)).alias("c")).first()["c"] < n * tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"eigenvector: no convergence after {most_rounds} rounds")
    return now.select("person_id", (F.col("y") * scale).alias("eigenvector"))


def core_numbers(vertices: DataFrame, edges: DataFrame, most_rounds: int = 500) -> DataFrame:
    """``(person_id, core_number)``: each node takes the h-index of its neighbours' values, from the degrees on, to the fixpoint.

    A graph within csr's bounds is taken apart as arrays.
    """
    graph = csr.compact(vertices, edges)
    if graph is not None:
        return csr.in_task(vertices.sparkSession, graph, "person_id long, core_number long", lambda g: [g.ids, csr.cores(g)])
    adj = stored(adjacency(edges))
    kept = now = stored(degrees(vertices, edges).withColumnRenamed("degree", "c"))
    order = Window.partitionBy("src").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(most_rounds):
        # values above the own one count like it; neighbours are counted by value before they meet, so a hub's are few rows
        own = now.select(F.col("person_id").alias("src"), F.col("c").alias("top"))
        seen = adj.join(now, adj["dst"] == now["person_id"]).groupBy("src", "c").agg(F.count("*").alias("k"))
        counts = seen.join(own, "src").groupBy("src", F.least("c", "top").alias("c")).agg(F.sum("k").alias("k"))
        h = counts.withColumn("r", F.sum("k").over(order)).groupBy(F.col("src").alias("person_id")).agg(F.max(F.least("c", "r")).alias("h"))
        after = stored(now.join(h, "person_id", "left").select("person_id", F.col("c").alias("before"), F.least("c", F.coalesce("h", F.lit(0))).cast("long").alias("c")))
        released(kept)
        kept, now = after, after.select("person_id", "c")
        if after.where("before <> c").isEmpty():
            return now.withColumnRenamed("c", "core_number")
    raise RuntimeError(f"core_numbers: no fixpoint after {most_rounds} rounds")


def bridges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(from_id, to_id)`` of the edges on no cycle.

    Cycle-space sampling: each edge outside a breadth-first forest gets a random 64-bit label, and a forest edge the
    exclusive or of the labels that cover it, summed from the leaves up. An edge is a bridge if that is 0 (wrongly so
    with a chance of 2^-63). A graph within csr's bounds is solved as arrays.
    """
    graph = csr.compact(vertices, edges)
    if graph is not None:

        def cut(g: csr.Csr) -> list[np.ndarray]:
            ends = [g.ids[x] for x in csr.bridge_ends(g)]
            return [np.minimum(*ends), np.maximum(*ends)]

        return csr.in_task(vertices.sparkSession, graph, "from_id long, to_id long", cut)
    roots = connected_components(vertices, edges).where("person_id = component").select("person_id")
    adj = stored(adjacency(edges)).withColumnRenamed("src", "node")
    front = roots.select(F.col("person_id").alias("node"))
    tree = stored(front.withColumns({"parent": F.lit(None).cast("long"), "d": F.lit(0)}))
    front, seen, d = tree.select("node"), tree.select("node"), 0
    while True:
        d += 1
        reached = front.join(adj, "node").groupBy(F.col("dst").alias("x")).agg(F.min("node").alias("parent")).withColumnRenamed("x", "node")
        level = stored(reached.join(seen, "node", "left_anti").withColumn("d", F.lit(d)))
        if level.isEmpty():
            break
        seen = front.unionByName(level.select("node"))
        front = level.select("node")
        tree = tree.unionByName(level)
    tree = stored(tree)
    pairs = tree.where("parent IS NOT NULL").select(F.least("node", "parent").alias("from_id"), F.greatest("node", "parent").alias("to_id"))
    rest = edges.select("from_id", "to_id").join(pairs, ["from_id", "to_id"], "left_anti").withColumn("label", F.xxhash64(F.lit(7), "from_id", "to_id"))
    own = rest.select(F.explode(F.array("from_id", "to_id")).alias("node"), "label").groupBy("node").agg(F.bit_xor("label").alias("x"))
    state = stored(tree.join(own, "node", "left").select("node", "parent", "d", F.coalesce("x", F.lit(0)).alias("x")))
    below, found = None, None
    for depth in range(d - 1, 0, -1):
        level = state.where(F.col("d") == depth)
        if below is not None:
            level = level.join(below, "node", "left").select("node", "parent", "d", F.col("x").bitwiseXOR(F.coalesce("b", F.lit(0))).alias("x"))
        level = stored(level)
        cut = level.where("x = 0").select("node", "parent")
        found = cut if found is None else found.unionByName(cut)
        below = level.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("b"))
    if found is None:
        return edges.select("from_id", "to_id").where("false")
    return found.select(F.least("node", "parent").alias("from_id"), F.greatest("node", "parent").alias("to_id"))


def bridge_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, is_bridge, incident_bridges)``."""
    ends = bridges(vertices, edges).select(F.explode(F.array("from_id", "to_id")).alias("person_id")).groupBy("person_id").agg(F.count("*").alias("b"))
    return vertices.join(ends, "person_id", "left").select("person_id", (F.coalesce("b", F.lit(0)) > 0).cast("int").alias("is_bridge"), F.coalesce("b", F.lit(0)).cast("long").alias("incident_bridges"))


def pivots(vertices: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` vertices chosen by the hash of seed and id."""
    return vertices.orderBy(dice(seed, "person_id"), "person_id").limit(k).select("person_id")


def betweenness(vertices: DataFrame, edges: DataFrame, k: int | None = None, seed: int = 42, only: str | None = None) -> DataFrame:
    """``(person_id, betweenness, load_centrality)``, or ``only`` one of them, from all sources or from ``k`` pivots scaled by n / k.

    Both are normalised by 1 / ((n - 1)(n - 2)); 0 below three nodes. In a graph within csr's bounds tasks search from
    their sources over arrays; beyond, levels are rows.
    """
    n = vertices.count()
    sources = vertices if k is None or k >= n else stored(pivots(vertices, k, seed))
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / min(n, k or n)) if n > 2 else 0.0
    parts = {"betweenness": "dependency", "load_centrality": "load"}
    if only is not None and only not in parts:
        raise ValueError(f"unknown measure {only!r}")
    graph = csr.compact(vertices, edges)
    flow = shortest_path_flow(edges, sources) if graph is None else csr.flow_sums(vertices.sparkSession, graph, _ids(sources), only=parts.get(only))
    values = [(F.coalesce(part, F.lit(0.0)) * scale).alias(name) for name, part in parts.items() if only in (None, name)]
    return vertices.join(flow, "person_id", "left").select("person_id", *values)


def _ids(sources: DataFrame) -> np.ndarray:
    return sources.select(F.col("person_id").cast("long")).toArrow()["person_id"].to_numpy()


def distance_sums(vertices: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(person_id, reached, total, inverse)`` of each source: nodes reached besides itself, sums of distances and of 1 / distance.

    A graph within csr's bounds is searched for 64 sources at a time by each task; beyond, distances are rows.
    """
    graph = csr.compact(vertices, edges)
    if graph is not None:
        return csr.distance_sums(vertices.sparkSession, graph, None if sources is vertices else _ids(sources))
    far = bfs(edges, sources).where("d > 0")
    sums = far.groupBy(F.col("src").alias("person_id")).agg(F.count("*").alias("reached"), F.sum("d").cast("long").alias("total"), F.sum(1.0 / F.col("d")).alias("inverse"))
    return sources.select("person_id").join(sums, "person_id", "left").na.fill(0)


def closeness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, closeness)``: (r / sum of distances) * (r / (n - 1)) with r nodes reached besides itself; 0 for isolated ones."""
    n = vertices.agg(F.count("*").alias("n"))
    r = F.col("reached")
    value = F.coalesce(F.try_divide(r, F.col("total")) * F.try_divide(r, F.col("n") - 1), F.lit(0.0))
    return distance_sums(vertices, edges, vertices).join(F.broadcast(n)).select("person_id", value.alias("closeness"))


def global_efficiency(vertices: DataFrame, edges: DataFrame, k: int | None = 30, seed: int = 42) -> DataFrame:
    """One row ``(sources, global_efficiency)``: the mean of 1 / distance from ``k`` pivots (None: all) to the n - 1 others; 0 below two nodes."""
    n = vertices.count()
    sources = vertices if k is None or k >= n else stored(pivots(vertices, k, seed))
    used = min(n, k) if k is not None else n
    near = distance_sums(vertices, edges, sources).agg(F.coalesce(F.sum("inverse"), F.lit(0.0)).alias("s"))
    return near.select(F.lit(used).cast("long").alias("sources"), (F.col("s") / float(used * (n - 1)) if n > 1 else F.lit(0.0)).alias("global_efficiency"))
