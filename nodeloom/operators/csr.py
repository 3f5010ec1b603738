"""Kernels over a graph that every executor holds whole, as arrays of bounded size; larger graphs go by DataFrames, with the same results.

Searches run for 64 sources at a time: a node's bits say which sources have reached it, and a level is one pass over the edges.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes and edges that are sent to executors: at most 160 MB of arrays.
MOST_NODES, MOST_EDGES = 4_000_000, 12_000_000
WORD = 64
#: Words of a node's bits at most where all nodes are sources, and bytes of all nodes' bits of more than WORDS words.
MOST_WORDS, WIDE = 32, 1 << 25
#: Words of a node's bits there in any graph; entries that are read at a time; neighbours that are read one by one in all nodes together.
WORDS, CHUNK, SLOTS = 8, 1 << 20, 256


@dataclass(frozen=True)
class Csr:
    """Sorted ids, and for the node at place i its neighbours' places ``to[start[i]:start[i + 1]]``."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray

    def reduced(self, of: np.ufunc, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``out`` with each node's neighbours' ``x`` put together by ``of``, where it has any; CHUNK entries are read at a time."""
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.to), CHUNK)), len(self.ids)))
        for a, b in zip(np.append(0, cuts).tolist(), cuts.tolist()):
            some = a + np.flatnonzero(np.diff(self.start[a : b + 1]))
            if len(some):
                out[some] = of.reduceat(x[self.to[self.start[a] : self.start[b]]], self.start[some] - self.start[a])
        return out

    def gathered(self, bits: np.ndarray) -> np.ndarray:
        """For each node the union of its neighbours' ``bits``."""
        return self.reduced(np.bitwise_or, bits, np.zeros(len(self.ids), bits.dtype))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each node the sum of its neighbours' ``x``."""
        return self.reduced(np.add, x, np.zeros(len(self.ids)))

    def entries(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many neighbours each of ``nodes`` has, their places in ``to``, node by node)."""
        many = self.start[nodes + 1] - self.start[nodes]
        return many, np.repeat(self.start[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def levels(self, sources: np.ndarray, alive: np.ndarray | None = None):
        """Yields (d, bits newly reached) of up to WORD sources' searches, over the nodes that are ``alive``."""
        front = np.zeros(len(self.ids), np.uint64)
        front[sources] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        seen = front.copy()
        if alive is not None:
            seen[~alive] = ~np.uint64(0)
        d = 0
        while True:
            d += 1
            front = self.gathered(front) & ~seen
            if not front.any():
                return
            seen |= front
            yield d, front

    def efficiency(self, sources: np.ndarray, alive: np.ndarray | None = None) -> float:
        """The sum of 1 / distance from the sources to the nodes they reach."""
        return float(sum(np.bitwise_count(front).sum() / d for d, front in self.levels(sources, alive)))

    def from_each(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes reached, sum of distances, sum of 1 / distance) of each of up to WORD sources, itself left out."""
        reached, total, inverse = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64), np.zeros(len(sources))
        for d, front in self.levels(sources):
            some = front[front != 0]
            own = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)[: len(sources)]
            reached, total, inverse = reached + own, total + d * own, inverse + own / d
        return reached, total, inverse

    def union(self, bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For each of ``nodes`` the union of its neighbours' rows of ``bits``."""
        many = self.start[nodes + 1] - self.start[nodes]
        order = np.argsort(-many, kind="stable")
        first, sorted_ = self.start[nodes[order]], -many[order]
        out = np.zeros((len(nodes), bits.shape[1]), bits.dtype)
        for slot in range(min(SLOTS, int(many.max(initial=0)))):
            some = np.searchsorted(sorted_, -slot)
            out[:some] |= bits.take(self.to.take(first[:some] + slot), axis=0, mode="clip")
        for i in range(np.searchsorted(sorted_, -SLOTS)):
            for a in range(first[i] + SLOTS, first[i] - sorted_[i], CHUNK // WORDS):
                out[i] |= np.bitwise_or.reduce(bits.take(self.to[a : min(a + CHUNK // WORDS, first[i] - sorted_[i])], axis=0), axis=0)
        back = np.empty_like(out)
        back[order] = out
        return back

    def spread(self, sources: np.ndarray):
        """Yields (d, nodes, how many of the sources are at distance d from each) of any number of sources' searches, WORD to a word of bits.

        A level reads the neighbours of nodes next to its front only, without those that all sources have reached.
        """
        k = np.arange(len(sources))
        seen = np.zeros((len(self.ids), -(-len(sources) // WORD)), np.uint64)
        seen[sources, k // WORD] = np.uint64(1) << (k % WORD).astype(np.uint64)
        front, full, at, d = seen.copy(), np.bitwise_or.reduce(seen[sources], axis=0), sources, 0
        while len(at):
            d += 1
            near = np.full(len(self.ids), 4 * len(at) > len(self.ids))
            for a in () if near.all() else range(0, len(at), CHUNK // 16):
                near[self.to[self.entries(at[a : a + CHUNK // 16])[1]]] = True
            nodes = np.flatnonzero(near)
            nodes = nodes[(seen[nodes] != full).any(axis=1)]
            new = self.union(front, nodes) & ~seen[nodes]
            some = new.any(axis=1)
            front[at] = 0
            at, new = nodes[some], new[some]
            front[at] = new
            seen[at] |= new
            if len(at):
                yield d, at, np.bitwise_count(new).sum(axis=1, dtype=np.int64)

    def flow(self, source: int, only: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Brandes' dependency and Newman's load of every node from one source; zeros for the one that is not ``only``."""
        n = len(self.ids)
        depth = np.full(n, -1, np.int16 if n < 1 << 15 else np.int32)
        sigma, preds = np.zeros(n), np.zeros(n)
        depth[source], sigma[source] = 0, 1.0
        front, steps, d = np.array([source]), [], 0
        while len(front):
            d += 1
            many, at = self.entries(front)
            near = self.to[at]
            ahead = depth[near] < 0
            u, v = np.repeat(front.astype(np.int32), many)[ahead], near[ahead]
            depth[v] = d
            if only != "load":
                sigma += np.bincount(v, sigma[u], n)
            if only != "dependency":
                preds += np.bincount(v, minlength=n)
            steps.append((u, v))
            front = np.flatnonzero(depth == d)
        delta, packets = np.zeros(n), np.zeros(n)
        for u, v in reversed(steps):
            if len(u) and only != "load":
                delta += np.bincount(u, sigma[u] * ((1 + delta) / np.maximum(sigma, 1.0))[v], n)
            if len(u) and only != "dependency":
                packets += np.bincount(u, ((1 + packets) / np.maximum(preds, 1.0))[v], n)
        delta[source] = packets[source] = 0.0
        return delta, packets


    def ball(self, node: int, hops: int) -> np.ndarray:
        """Sorted places within ``hops`` of ``node``."""
        seen = front = np.array([node])
        for _ in range(hops):
            front = np.setdiff1d(self.to[self.entries(front)[1]], seen)
            seen = np.union1d(seen, front)
        return seen

    def inside(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges between the sorted ``nodes``, as (i, j), i < j, of places in them."""
        many, at = self.entries(nodes)
        near = self.to[at]
        j = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
        i = np.repeat(np.arange(len(nodes)), many)
        both = (nodes[j] == near) & (i < j)
        return i[both], j[both]


class Around:
    """The enclosing subgraphs of many pairs of places of ``graph`` at once, without their target edges."""

    def __init__(self, graph: Csr, hops: int):
        self.graph, self.hops, self.mark = graph, hops, np.full(len(graph.ids), -1, np.int32)
        # entries that a ball reads at most
        self.cost = np.diff(graph.start).astype(float)
        for _ in range(hops):
            self.cost = self.cost + graph.sums(self.cost)

    def batches(self, a: np.ndarray, b: np.ndarray):
        """Slices of the pairs that read CHUNK / 4 entries at most, or are one pair."""
        cost, first = np.cumsum(self.cost[a] + self.cost[b]), 0
        while first < len(a):
            before = cost[first - 1] if first else 0.0
            last = max(first + 1, int(np.searchsorted(cost, before + CHUNK / 4, "right")))
            yield slice(first, last)
            first = last

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the pair and place of each node, sorted; each edge's ends in both directions as positions in these, sorted)."""
        g, low = self.graph, (1 << 32) - 1
        k = np.arange(len(a), dtype=np.int64) << 32
        seen = front = np.unique(np.concatenate([k | a, k | b]))
        for _ in range(self.hops):
            many, at = g.entries(front & low)
            near = np.unique(np.repeat(front & ~low, many) | g.to[at])
            front = np.setdiff1d(near, seen, assume_unique=True)
            seen = np.sort(np.concatenate([seen, front]))
        nodes, own = seen & low, seen >> 32
        many, at = g.entries(nodes)
        j = g.to[at]
        cuts = np.append(np.searchsorted(seen, k), len(seen))
        ends = np.append(0, np.cumsum(many))[cuts]
        for c, d, e, f in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            self.mark[nodes[c:d]] = np.arange(c, d)
            j[e:f] = self.mark[j[e:f]]
            self.mark[nodes[c:d]] = -1
        inside = j >= 0
        i, j = np.repeat(np.arange(len(nodes)), many)[inside], j[inside].astype(np.int64)
        x, y, of = nodes[i], nodes[j], own[i]
        left = ~(((x == a[of]) & (y == b[of])) | ((x == b[of]) & (y == a[of])))
        return own, nodes, i[left], j[left]


class Balls:
    """Balls of ``hops`` around the places of ``graph``; CHUNK nodes of them are kept in all."""

    def __init__(self, graph: Csr, hops: int):
        self.graph, self.hops, self.kept, self.nodes = graph, hops, {}, 0

    def ball(self, place: int) -> np.ndarray:
        if place not in self.kept:
            if self.nodes >= CHUNK:
                self.kept, self.nodes = {}, 0
            self.kept[place] = self.graph.ball(place, self.hops)
            self.nodes += len(self.kept[place])
        return self.kept[place]

    def around(self, a: int, b: int) -> np.ndarray:
        """Sorted places of both balls."""
        return np.union1d(self.ball(a), self.ball(b))


#: The graph that was asked for last with what tells it, and its broadcast.
_LAST: dict[str, object] = {}


def compact(vertices: DataFrame, edges: DataFrame) -> Csr | None:
    """The graph as arrays, or None if it is larger than the bounds. That of a table that ``stored`` wrote is kept until another is asked for."""
    at = getattr(edges, "stored_at", None)
    key = (vertices.sparkSession.sparkContext.applicationId, at, vertices.semanticHash())
    if at is not None and _LAST.get("key") == key:
        return _LAST["graph"]
    _LAST.clear()
    if vertices.count() > MOST_NODES or edges.count() > MOST_EDGES:
        return None
    graph = _built(vertices, edges)
    if at is not None:
        _LAST.update(key=key, graph=graph)
    return graph


def _built(vertices: DataFrame, edges: DataFrame) -> Csr:
    ids = np.sort(vertices.select(F.col("person_id").cast("long")).distinct().toArrow()["person_id"].to_numpy())
    short = "int" if len(ids) and -(1 << 31) <= ids[0] and ids[-1] < 1 << 31 else "long"
    pairs = edges.select(F.col("from_id").cast(short), F.col("to_id").cast(short)).toArrow()
    n, m = len(ids), pairs.num_rows
    # both ends in one number, filled and sorted in place, so that the driver holds few copies
    both = np.empty(2 * m, np.int64)
    done = 0
    for batch in pairs.to_batches():
        a, b = (np.searchsorted(ids, batch.column(i).to_numpy().astype(np.int64)) for i in (0, 1))
        both[done : done + len(a)] = a << 32 | b
        both[m + done : m + done + len(a)] = b << 32 | a
        done += len(a)
    del pairs
    both.sort()
    start = np.searchsorted(both, np.arange(n + 1) << 32)
    to = np.empty(2 * m, np.int32)
    for a in range(0, 2 * m, CHUNK):
        to[a : a + CHUNK] = both[a : a + CHUNK] & ((1 << 32) - 1)
    return Csr(ids, start, to)


def _sent(spark, graph: Csr):
    """The broadcast of ``graph``; the graph that is kept is sent once."""
    if _LAST.get("graph") is not graph:
        return spark.sparkContext.broadcast(graph)
    if "sent" not in _LAST:
        _LAST["sent"] = spark.sparkContext.broadcast(graph)
    return _LAST["sent"]


def _over(spark, graph: Csr, parts: int, schema: str, run) -> DataFrame:
    """Rows that ``run(graph, part)`` gives as arrays for each of 0..parts - 1, in parallel."""
    held = _sent(spark, graph)
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in run(held.value, part)], names=names)

    return spark.range(0, parts, 1, max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(each, schema)


def in_task(spark, graph: Csr, schema: str, run) -> DataFrame:
    """Rows that ``run(graph)`` gives as arrays, by one task when they are read, beside other stages."""
    return _over(spark, graph, 1, schema, lambda g, _: run(g))


def words_at_once(n: int, cores: int) -> int:
    """Words of bits for searches from all of ``n`` nodes: more than WORDS where they fit WIDE bytes and every core still gets four searches."""
    return max(WORDS, min(MOST_WORDS, WIDE // (8 * max(1, n)), n // (4 * WORD * cores)))


def distance_sums(spark, graph: Csr, sources: np.ndarray | None = None) -> DataFrame:
    """``(person_id, reached, total, inverse)`` of each source (ids; None: all): nodes reached besides itself, sums of distances and of 1 / distance.

    From all nodes, what the sources of a search are to a node is what the node is to them, so a task adds up by node.
    """
    schema = "person_id long, reached long, total long, inverse double"
    if sources is None or len(sources) >= len(graph.ids):
        size = WORD * words_at_once(len(graph.ids), spark.sparkContext.defaultParallelism)
        # sources of one component are searched together
        places = np.argsort(components(graph), kind="stable")
        searches = -(-len(places) // size)
        parts = min(searches, 8 * spark.sparkContext.defaultParallelism)

        def run_all(g: Csr, part: int):
            reached, total, inverse = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids))
            for i in range(part * searches // parts, (part + 1) * searches // parts):
                for d, at, many in g.spread(places[i * size : (i + 1) * size]):
                    reached[at] += many
                    total[at] += d * many
                    inverse[at] += many / d
            some = np.flatnonzero(reached)
            return [g.ids[some], reached[some], total[some], inverse[some]]

        sums = _over(spark, graph, parts, schema, run_all).groupBy("person_id").agg(*[F.sum(c).alias(c) for c in ("reached", "total", "inverse")])
        every = spark.createDataFrame(pa.table({"person_id": pa.array(graph.ids, pa.int64())}))
        return every.join(sums, "person_id", "left").na.fill(0)
    places = np.searchsorted(graph.ids, np.sort(sources))

    def run(g: Csr, part: int):
        own = places[part * WORD : (part + 1) * WORD]
        return [g.ids[own], *g.from_each(own)]

    return _over(spark, graph, -(-len(places) // WORD), schema, run)


def flow_sums(spark, graph: Csr, sources: np.ndarray | None = None, block: int = 16, only: str | None = None) -> DataFrame:
    """``(person_id, dependency, load)`` summed over the sources (ids; None: all); zeros for the one that is not ``only``."""
    places = np.arange(len(graph.ids)) if sources is None else np.searchsorted(graph.ids, np.sort(sources))
    # a part gives a row for each node, so there are few parts, and as many for each core
    block = max(1, min(block, -(-len(places) // (2 * spark.sparkContext.defaultParallelism))))

    def run(g: Csr, part: int):
        dependency, load = np.zeros(len(g.ids)), np.zeros(len(g.ids))
        for p in places[part * block : (part + 1) * block]:
            a, b = g.flow(int(p), only)
            dependency, load = dependency + a, load + b
        some = np.flatnonzero(dependency + load)
        return [g.ids[some], dependency[some], load[some]]

    parts = _over(spark, graph, -(-len(places) // block), "person_id long, dependency double, load double", run)
    return parts.groupBy("person_id").agg(F.sum("dependency").alias("dependency"), F.sum("load").alias("load"))


def eigenvector(graph: Csr, rounds: int | None, tolerance: float, most_rounds: int) -> np.ndarray:
    """Power iteration as in ``iterative.eigenvector``, for the node at each place."""
    n = len(graph.ids)
    x = np.full(n, 1.0 / max(1, n))
    for _ in range(rounds if rounds is not None else most_rounds):
        y = x + graph.sums(x)
        length = np.sqrt((y * y).sum())
        after = y / (length if length else 1.0)
        change, x = np.abs(after - x).sum(), after
        if rounds is None and change < n * tolerance:
            return x
    if rounds is None:
        raise RuntimeError(f"eigenvector: no convergence after {most_rounds} rounds")
    return x


def components(graph: Csr) -> np.ndarray:
    """The place of the smallest node that each node reaches: labels of the neighbourhood, then the label of the label."""
    label = np.arange(len(graph.ids))
    while True:
        low = graph.reduced(np.minimum, label, label.copy())
        low = np.minimum(low, label)
        low = np.minimum(low, low[low])
        if np.array_equal(low, label):
            return label
        label = low


def components_without(spark, graph: Csr, removed: dict[str, np.ndarray]) -> DataFrame:
    """``(strategy, person_id, component)`` of the nodes that are left without each strategy's removed ids."""
    each = list(removed.items())

    def run(g: Csr, part: int):
        name, gone = each[part]
        alive = ~np.isin(g.ids, gone)
        owner = np.repeat(np.arange(len(g.ids), dtype=np.int32), np.diff(g.start))
        left = alive[owner] & alive[g.to]
        label = components(Csr(g.ids, np.append(0, np.cumsum(left))[g.start], g.to[left]))
        return [[name] * int(alive.sum()), g.ids[alive], g.ids[label[alive]]]

    return _over(spark, graph, len(each), "strategy string, person_id long, component long", run)


def cores(graph: Csr) -> np.ndarray:
    """The core number of the node at each place: nodes of the least degree go first, and their neighbours' degrees fall."""
    left = np.diff(graph.start)
    core = np.zeros(len(graph.ids), np.int64)
    alive = np.ones(len(graph.ids), bool)
    rest = np.arange(len(graph.ids))
    k = 0
    while len(rest):
        k = max(k, int(left[rest].min()))
        gone = rest[left[rest] <= k]
        while len(gone):
            core[gone], alive[gone] = k, False
            near, many = np.unique(graph.to[graph.entries(gone)[1]], return_counts=True)
            left[near] -= many
            gone = near[alive[near] & (left[near] <= k)]
        rest = rest[alive[rest]]
    return core


def bridge_ends(graph: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The ends' places of the edges on no cycle, by labels as in ``iterative.bridges``."""
    n = len(graph.ids)
    parent, seen = np.full(n, -1), np.zeros(n, bool)
    front = np.flatnonzero(components(graph) == np.arange(n))
    seen[front] = True
    levels = []
    while len(front):
        many, at = graph.entries(front)
        near, above = graph.to[at], np.repeat(front, many)
        new = ~seen[near]
        front, first = np.unique(near[new], return_index=True)
        parent[front] = above[new][first]
        seen[front] = True
        levels.append(front)
    labels = np.random.default_rng(7).integers(1 << 63, size=len(graph.to), dtype=np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(graph.start))
    rest = (parent[owner] != graph.to) & (parent[graph.to] != owner) & (owner < graph.to)
    x = np.zeros(n, np.int64)
    for ends in (owner, graph.to):
        np.bitwise_xor.at(x, ends[rest], labels[rest])
    for level in reversed(levels):
        np.bitwise_xor.at(x, parent[level], x[level])
    cut = np.flatnonzero((parent >= 0) & (x == 0))
    return cut, parent[cut]


def hash_order(ids: np.ndarray, seed: int) -> np.ndarray:
    """Places in the order of ``dice(seed, person_id)``."""
    keys = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids.tolist()]
    return np.array(sorted(range(len(keys)), key=lambda p: (keys[p], ids[p])), np.int64)


def efficiency_steps(spark, graph: Csr, orders: list[tuple[str, np.ndarray]], k: int, seed: int) -> DataFrame:
    """``(strategy, step, global_efficiency)``: from the first ``k`` remaining nodes in hash order, after each step of each (strategy, ids in order of removal)."""
    order = hash_order(graph.ids, seed)
    steps = [(name, removed, step) for name, removed in orders for step in range(len(removed) + 1)]
    block = 8

    def run(g: Csr, part: int):
        out = []
        for name, removed, step in steps[part * block : (part + 1) * block]:
            alive = ~np.isin(g.ids, removed[:step])
            sources = order[alive[order]][: min(k, WORD)]
            n = int(alive.sum())
            out.append((name, step, g.efficiency(sources, alive) / (len(sources) * (n - 1)) if n > 1 else 0.0))
        names, numbers, values = zip(*out, strict=True)
        return [list(names), np.array(numbers, np.int64), np.array(values, np.float64)]

    return _over(spark, graph, -(-len(steps) // block), "strategy string, step long, global_efficiency double", run)


def enclosing_sizes(graph: Csr, pairs: DataFrame, hops: int) -> DataFrame:
    """``(from_id, to_id, n_nodes, n_edges)`` of the subgraph around each distinct pair. A task keeps balls of CHUNK nodes in all."""
    held = _sent(pairs.sparkSession, graph)
    rows = pairs.select(F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id")).distinct()
    rows = rows.repartitionByRange(8 * pairs.sparkSession.sparkContext.defaultParallelism, "from_id", "to_id").sortWithinPartitions("from_id", "to_id")

    def each(batches):
        g = held.value
        balls = Balls(g, hops)
        for batch in batches:
            ends = [np.searchsorted(g.ids, c.to_numpy()).tolist() for c in batch.columns]
            nodes, edges = [], []
            for pair in zip(*ends, strict=True):
                both = balls.around(*pair)
                nodes.append(len(both))
                edges.append(len(g.inside(both)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int32()), pa.array(edges, pa.int32())], names=["from_id", "to_id", "n_nodes", "n_edges"])

    return rows.mapInArrow(each, "from_id long, to_id long, n_nodes int, n_edges int")
