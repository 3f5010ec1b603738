"""Role inference by clustering and by supervised models, and node embeddings."""

from __future__ import annotations

from array import array
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import dice
from nodeloom.operators import forest
from nodeloom.operators.features import priority_features, robust_scaled, rule_roles
from nodeloom.operators.graph import adjacency
from nodeloom.operators.store import stored

#: Points whose spanning tree one task builds; that of more takes rounds over blocks of BLOCK points, which meet STRIP points at a time.
MOST_POINTS = 20_000
BLOCK, STRIP = 64, 1024
#: Nearest points that each point keeps for the rounds.
NEAREST = 5
NOISE = -1


def _assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def kmeans_clusters(scaled: DataFrame, columns: list[str], k: int = 4, seeds: int = 10) -> DataFrame:
    """``(person_id, cluster)`` by the best of ``seeds`` starts, which run at once: a round of one start is too small a job for a cluster."""
    from pyspark.ml.clustering import KMeans

    rows = stored(scaled.select("person_id", *columns))
    ready = _assembled(rows, columns).select("person_id", "features").cache()
    try:
        with ThreadPoolExecutor(seeds) as pool:
            best = min(pool.map(lambda i: KMeans(k=k, seed=42 + i, maxIter=50).fit(ready), range(seeds)), key=lambda m: m.summary.trainingCost)
        out = stored(best.transform(ready).select("person_id", F.col("prediction").alias("cluster")))
    finally:
        ready.unpersist()
    return out


def hdbscan_labels(points: np.ndarray, least: int = 3, epsilon: float = 0.01) -> np.ndarray:
    """Leaf clusters of the density hierarchy with core distance 0 (one neighbour), -1 for noise.

    The minimum spanning tree's edges, longest first, split the data; parts of fewer than ``least`` points fall out as
    noise; a part that no longer splits in two is a leaf. A leaf born at a distance under ``epsilon`` goes up to the
    first ancestor that is not. One cluster of everything is none.
    """
    return leaf_labels(len(points), dense_tree(points), least, epsilon)


def dense_tree(points: np.ndarray) -> list[tuple[float, int, int]]:
    """The minimum spanning tree's edges (distance, a, b), by Prim over dense distances."""
    n = len(points)
    near, parent, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = (d < near) & ~done
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(done, np.inf, near).argmin())
        edges.append((near[at], parent[at], at))
    return edges


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each of ``x`` to each of ``y``, added up column by column."""
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d += (x[:, None, k] - y[None, :, k]) ** 2
    return d


def _dealt(points: np.ndarray, block: int) -> np.ndarray:
    """The points' numbers in an order in which each ``block`` of them lie together: halves by the widest column."""
    order, stack = np.arange(len(points)), [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= block:
            continue
        own = points[order[a:b]]
        half = block * (-(-(b - a) // block) // 2)
        order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(own.max(0) - own.min(0)))], half)]
        stack += [(a, a + half), (a + half, b)]
    return order


class _Blocks:
    """Points in the order of ``_dealt`` and the boxes of their blocks. A box is no farther than its points, also in rounded numbers."""

    def __init__(self, points: np.ndarray, number: np.ndarray, block: int, strip: int):
        self.points, self.number, self.block, self.step = points, number, block, max(1, strip // block)
        starts = np.arange(0, len(points), block)
        self.low, self.high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)

    def gaps(self, at: int) -> np.ndarray:
        """Squared distance of the box ``at`` to each box."""
        out = np.zeros(len(self.low))
        for k in range(self.points.shape[1]):
            out += np.maximum(0, np.maximum(self.low[:, k] - self.high[at, k], self.low[at, k] - self.high[:, k])) ** 2
        return out

    def meeting(self, own: np.ndarray, boxes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``own`` have one of the boxes within their ``bound``, the points of the boxes that are within one's)."""
        d = np.zeros((len(own), len(boxes)))
        for k in range(self.points.shape[1]):
            x = self.points[own, k][:, None]
            d += np.maximum(0, np.maximum(self.low[None, boxes, k] - x, x - self.high[None, boxes, k])) ** 2
        need = d <= bound[:, None]
        return np.flatnonzero(need.any(axis=1)), self.rows(boxes[need.any(axis=0)])

    def rows(self, blocks: np.ndarray) -> np.ndarray:
        at = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        return at[at < len(self.points)]

    def nearest(self, at: int, k: int) -> np.ndarray:
        """The ``k`` nearest others of each point of a block; which of those at the k-th distance is open."""
        own = self.rows(np.array([at]))
        best, who = np.full((len(own), k), np.inf), np.zeros((len(own), k), np.int32)
        gaps = self.gaps(at)
        gaps[at] = -1
        near = np.argsort(gaps)
        for a in range(0, len(near), self.step):
            if gaps[near[a]] > best.max():
                break
            some, other = self.meeting(own, near[a : a + self.step], best.max(axis=1))
            if not len(some):
                continue
            d = _squares(self.points[own[some]], self.points[other])
            d[own[some][:, None] == other[None, :]] = np.inf
            both, names = np.hstack([best[some], d]), np.hstack([who[some], np.broadcast_to(other.astype(np.int32), d.shape)])
            first = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[some], who[some] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
        return who

    def outside(self, at: int, asked: np.ndarray, part: np.ndarray, pure: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """[part, d, a, b] of edges from a block's asked points to other parts, with the least (d, a, b) of each part up to ``bound``, which falls."""
        own = self.rows(np.array([at]))
        own = own[asked[own]]
        mine = part[own]
        gaps, found = self.gaps(at), []
        if (mine == mine[0]).all():
            gaps[pure == mine[0]] = np.inf
        near = np.flatnonzero(gaps <= bound[mine].max())
        near = near[np.argsort(gaps[near])]
        for a in range(0, len(near), self.step):
            if gaps[near[a]] > bound[mine].max() or gaps[near[a]] == np.inf:
                break
            some, other = self.meeting(own, near[a : a + self.step], bound[mine])
            if not len(some):
                continue
            d, of = _squares(self.points[own[some]], self.points[other]), mine[some]
            d[of[:, None] == part[other][None, :]] = np.inf
            low = d.min(axis=1)
            np.minimum.at(bound, of, low)
            i, j = np.nonzero((d == low[:, None]) & ((low <= bound[of]) & (low < np.inf))[:, None])
            x, y = self.number[own[some][i]], self.number[other[j]]
            found.append([of[i], low[i], np.minimum(x, y), np.maximum(x, y)])
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64)]


def _least(part: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first edge by (d, a, b) of each part."""
    order = np.lexsort((b, a, d, part))
    first = order[np.append(True, np.diff(part[order]) != 0)] if len(order) else order
    return part[first], d[first], a[first], b[first]


def spanning_tree(spark, points: np.ndarray) -> list[tuple[float, int, int]]:
    """``tree_arrays`` as (distance, a, b)."""
    return list(zip(*(x.tolist() for x in tree_arrays(spark, points)), strict=True))


def tree_arrays(spark, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree's edges as arrays (distance, a, b), a < b, in rounds (Boruvka): parts take their least edges to others.

    Edges are in a strict order by (distance, a, b), so the tree is the only one. Equal points hang on the first of them,
    which stands for all. Tasks find the NEAREST points of each; a part whose least edge these tell needs no search. Where few
    parts are told, tasks search for the others, but the largest, from blocks in which a nearer one may be to those boxes that
    are no farther than the part's best so far and hold another part.
    """
    points = np.ascontiguousarray(points, float) + 0.0
    same = np.unique(points.view(f"V{8 * points.shape[1]}").ravel(), return_inverse=True)[1]
    first = np.minimum.reduceat(np.argsort(same, kind="stable"), np.append(0, np.cumsum(np.bincount(same))[:-1]))
    copies = np.flatnonzero(first[same] != np.arange(len(points)))
    edges = [(np.zeros(len(copies)), first[same][copies], copies)]
    del same
    number = first[_dealt(points[first], BLOCK)]
    p, n = points[number], len(number)
    k, cores = min(NEAREST, n - 1), spark.sparkContext.defaultParallelism
    if n == 1:
        return edges[0]
    blocks, held = -(-n // BLOCK), spark.sparkContext.broadcast((p, number, BLOCK, STRIP))
    parts = min(blocks, 8 * cores)

    def near(batches):
        every = _Blocks(*held.value)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = [every.nearest(at, k) for at in range(i * blocks // parts, (i + 1) * blocks // parts)]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.concatenate(found).tobytes()])], names=["i", "near"])

    told = sorted(spark.range(0, parts, 1, parts).mapInArrow(near, "i long, near binary").collect())
    who = np.concatenate([np.frombuffer(r["near"], np.int32) for r in told]).reshape(n, k)
    del told
    d = np.zeros((n, k))
    for c in range(p.shape[1]):
        d += (p[:, None, c] - p[who, c]) ** 2
    order = np.lexsort((number[who], d), axis=1)
    d, who = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)
    del order
    part, place, rows, left = np.arange(n, dtype=np.int32), np.zeros(n, np.int8), np.arange(n), n
    starts, at_number = np.arange(0, n, BLOCK), np.zeros(len(points), np.int32)
    at_number[number] = rows
    while left > 1:
        ask = rows[place < k]
        while len(ask):
            ask = ask[part[who[ask, place[ask]]] == part[ask]]
            place[ask] += 1
            ask = ask[place[ask] < k]
        has = place < k
        at = np.minimum(place, k - 1)
        own = np.where(has, d[rows, at], np.inf)
        open_ = np.where(own < d[:, -1], np.inf, d[:, -1])
        best, low = np.full(n, np.inf), np.full(n, np.inf)
        np.minimum.at(best, part, own)
        np.minimum.at(low, part, open_)
        some = np.flatnonzero(has & (own == best[part]))
        x, y = number[some], number[who[some, at[some]]]
        found = _least(part[some].astype(np.int64), own[some], np.minimum(x, y), np.maximum(x, y))
        sure = best < low
        roots = np.flatnonzero(part == rows)
        if 8 * sure[roots].sum() < len(roots):
            searched = ~sure
            searched[np.bincount(part, minlength=n).argmax()] = False
            asked = searched[part] & (open_ <= best[part])
            same = np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts)
            pure, busy = np.where(same, part[starts], -1), np.flatnonzero(np.logical_or.reduceat(asked, starts))
            sent = spark.sparkContext.broadcast((asked, part, pure, best, busy))
            tasks = min(len(busy), 8 * cores)

            def search(batches, sent=sent, tasks=tasks):
                every, (asked, part, pure, best, busy) = _Blocks(*held.value), sent.value
                for batch in batches:
                    for i in batch.column(0).to_pylist():
                        bound = best.copy()
                        found = [every.outside(at, asked, part, pure, bound) for at in busy[i * len(busy) // tasks : (i + 1) * len(busy) // tasks].tolist()]
                        out = _least(*[np.concatenate(c) for c in zip(*found, strict=True)])
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["part", "d", "a", "b"])

            more = spark.range(0, tasks, 1, tasks).mapInArrow(search, "part long, d double, a long, b long").toArrow()
            found = _least(*[np.concatenate([v, more[c].to_numpy()]) for v, c in zip(found, ("part", "d", "a", "b"), strict=True)])
            sent.destroy()
            sure |= searched
        chosen = sure[found[0]]
        of, d2, a, b = (v[chosen] for v in found)
        pa_, pb = part[at_number[a]], part[at_number[b]]
        to = np.arange(n, dtype=np.int32)
        to[of] = np.where(pa_ == of, pb, pa_)
        mutual = of[(to[to[of]] == of) & (of < to[of])]
        kept = ~np.isin(of, to[mutual])  # an edge that both ends take counts once
        to[mutual] = mutual
        edges.append((np.sqrt(d2[kept]), a[kept], b[kept]))
        while not np.array_equal(to, to[to]):
            to = to[to]
        part, left = to[part], left - int(kept.sum())
    held.destroy()
    return tuple(np.concatenate(c) for c in zip(*edges, strict=True))


def leaf_labels(n: int, edges: list[tuple[float, int, int]] | tuple[np.ndarray, np.ndarray, np.ndarray], least: int, epsilon: float) -> np.ndarray:
    """hdbscan_labels of n points from their minimum spanning tree, rows (d, a, b) or three arrays; some numbers for each point are held."""
    labels = np.full(n, NOISE)
    if n < 2 * least:
        return labels
    d, a, b = edges if isinstance(edges, tuple) else (np.array(c) for c in zip(*edges, strict=True))
    order = np.lexsort((b, a, d))
    # single linkage: node n + i joins two earlier ones at height[i]
    height = array("d", d[order].tobytes())
    one, other = (array("q", c[order].astype(np.int64).tobytes()) for c in (a, b))
    root, size = array("q", range(2 * n - 1)), array("q", [1]) * n + array("q", [0]) * (n - 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n - 1):
        x, y = find(one[i]), find(other[i])
        root[x] = root[y] = n + i
        size[n + i] = size[x] + size[y]
        one[i], other[i] = x, y

    # a part is known by its first node; up: the first part above it (or it) that was born at epsilon or more
    whole, chosen = 2 * n - 2, set()
    stack = [(whole, whole)]
    while stack:
        node, up = stack.pop()
        while node >= n:
            x, y, h = one[node - n], other[node - n], height[node - n]
            big = [c for c in (x, y) if size[c] >= least]
            if len(big) == 2:
                stack += [(c, up if h < epsilon else c) for c in big]
                break
            if not big:
                chosen.add(up)
                break
            node = big[0]
        else:
            chosen.add(up)
    chosen.discard(whole)
    for number, top in enumerate(sorted(chosen)):
        stack = [top]
        while stack:
            x = stack.pop()
            if x < n:
                labels[x] = number
            else:
                stack += (one[x - n], other[x - n])
    return labels


def hdbscan_clusters(scaled: DataFrame, columns: list[str], least: int = 3, epsilon: float = 0.01) -> DataFrame:
    """``(person_id, cluster)``. Beyond MOST_POINTS the tree is built by all tasks, and the hierarchy from its n - 1 edges on the driver."""
    if scaled.count() > MOST_POINTS:
        rows = scaled.select("person_id", *[F.col(c).cast("double").alias(c) for c in columns]).orderBy("person_id").toArrow()
        edges = tree_arrays(scaled.sparkSession, np.column_stack([rows[c].to_numpy() for c in columns]))
        labels = leaf_labels(rows.num_rows, edges, least, epsilon)
        return scaled.sparkSession.createDataFrame(pa.table({"person_id": rows["person_id"], "cluster": pa.array(labels, pa.int32())}))

    def cluster(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("person_id")
        points = np.column_stack([batch[c].to_numpy() for c in columns])
        return pa.table({"person_id": batch["person_id"], "cluster": pa.array(hdbscan_labels(points, least, epsilon), pa.int32())})

    return scaled.select("person_id", *[F.col(c).cast("double").alias(c) for c in columns]).groupBy(F.lit(True).alias("all")).applyInArrow(cluster, "person_id long, cluster int")


def cluster_roles(clusters: DataFrame, roles: DataFrame) -> DataFrame:
    """``(person_id, predicted_role)``: each cluster's majority role, ties to the role of the smallest id; noise is Peripheral."""
    both = clusters.join(roles.select("person_id", "role"), "person_id")
    votes = both.groupBy("cluster", "role").agg(F.count("*").alias("n"), F.min("person_id").alias("first"))
    best = votes.groupBy("cluster").agg(F.max_by("role", F.struct("n", -F.col("first"))).alias("major"))
    named = F.when(F.col("cluster") == NOISE, "Peripheral").otherwise(F.col("major"))
    return clusters.join(best, "cluster").select("person_id", named.alias("predicted_role"))


def _forest(columns: list[str], labels: DataFrame, trees: int, depth: int, leaf: int, seed: int):
    """A pipeline from ``columns``, ``role`` and ``weight`` to ``predicted_role``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol="role", outputCol="label").fit(labels)
    trees_ = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, maxMemoryInMB=1024)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), index, trees_, IndexToString(inputCol="prediction", outputCol="predicted_role", labels=index.labels)])


def _weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``c``, the rows of their role, and ``weight``: n / (classes * c)."""
    counts = rows.groupBy("role").agg(F.count("*").alias("c"))
    return rows.join(F.broadcast(counts), "role").withColumn("weight", F.lit(float(rows.count())) / (counts.count() * F.col("c")))


def importances(model, columns: list[str], k: int = 10) -> list[tuple[int, str, float]]:
    """(rank, feature, importance) of the ``k`` features that a forest's splits gain most by."""
    values = (model.importances if isinstance(model, forest.Forest) else model.stages[2].featureImportances.toArray()).tolist()
    best = sorted(zip(columns, values, strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return [(i, c, float(v)) for i, (c, v) in enumerate(best, 1)]


def supervised_roles(features: DataFrame, roles: DataFrame, columns: list[str], trees: int = 500, depth: int = 20, leaf: int = 2, folds: int = 5, seed: int = 42):
    """(model, ``(person_id, predicted_role, confidence)``, (mean, deviation) of the weighted F1 over the folds).

    The second supervised variant: one forest for each stratified fold, fitted on the others, and one on all rows, which
    predicts them. The model is one that ``save_model`` writes. Rows of up to forest.MOST_VALUES values are sent to all
    tasks, which grow the trees; more are fitted by Spark's forests.
    """
    from pyspark.ml.functions import vector_to_array

    from nodeloom.operators import metrics

    rows = stored(_weighted(metrics.stratified_folds(features.select("person_id", *columns).join(roles.select("person_id", "role"), "person_id"), "role", folds, seed)))
    score = lambda held: metrics.weighted_f1(metrics.role_report(metrics.confusion_matrix(held, "role", "predicted_role"))).first()["weighted_f1"]
    scores = []
    if rows.count() * len(columns) <= forest.MOST_VALUES:
        every = list(range(folds))
        told, model = forest.forests(rows, columns, "fold", [*[([g for g in every if g != f], [f]) for f in every], (every, every)], trees, depth, leaf, seed)
        told = stored(told)
        scores = [score(told.where(F.col("forest") == f).join(rows.select("person_id", "role"), "person_id")) for f in every]
        out = told.where(F.col("forest") == folds).select("person_id", "predicted_role", F.array_max("probability").alias("confidence"))
        return model, out, (float(np.mean(scores)), float(np.std(scores)))
    for fold in range(folds):
        model = _forest(columns, rows, trees, depth, leaf, seed).fit(rows.where(F.col("fold") != fold))
        held = model.transform(rows.where(F.col("fold") == fold))
        scores.append(score(held))
    model = _forest(columns, rows, trees, depth, leaf, seed).fit(rows)
    out = stored(model.transform(rows).select("person_id", "predicted_role", F.array_max(vector_to_array("probability")).alias("confidence")))
    return model, out, (float(np.mean(scores)), float(np.std(scores)))


def forest_roles(features: DataFrame, roles: DataFrame, columns: list[str], trees: int = 300, depth: int = 15, train: float = 0.7, seed: int = 42) -> DataFrame:
    """``(person_id, predicted_role, confidence)`` of a forest fitted on a stratified part, each class weighing n / (classes * its rows)."""
    from pyspark.ml.functions import vector_to_array

    rows = stored(features.select("person_id", *columns).join(roles.select("person_id", "role"), "person_id"))
    rows = _weighted(rows)
    place = F.row_number().over(Window.partitionBy("role").orderBy(dice(seed, "person_id")))
    rows = stored(rows.withColumn("fit", place <= F.ceil(F.col("c") * train)))
    if rows.count() * len(columns) <= forest.MOST_VALUES:
        told, _ = forest.forests(rows, columns, "fit", [([1], [0, 1])], trees, depth, 5, seed)
        return stored(told.select("person_id", "predicted_role", F.array_max("probability").alias("confidence")))
    model = _forest(columns, rows, trees, depth, 5, seed).fit(rows.where("fit"))
    out = model.transform(rows)
    return stored(out.select("person_id", "predicted_role", F.array_max(vector_to_array("probability")).alias("confidence")))


def infer_roles(features: DataFrame, persons: DataFrame, method: str = "rules", compat: bool = False) -> DataFrame:
    """``(person_id, predicted_role)`` by ``enhanced_clustering``, ``supervised`` or ``rules``.

    Clustering: density clusters of scaled priority features, or k-means if they are fewer than four. An unknown
    method is an error, or the rules with ``compat``.
    """
    if method in ("enhanced_clustering", "supervised"):
        columns = priority_features(features)
        scaled = stored(robust_scaled(features.select("person_id", *columns), columns))
        if method == "supervised":
            return forest_roles(scaled, persons, columns).drop("confidence")
        found = stored(hdbscan_clusters(scaled, columns))
        few = found.where(F.col("cluster") != NOISE).select("cluster").distinct().count() < 4
        return cluster_roles(kmeans_clusters(scaled, columns) if few else found, persons)
    if method != "rules" and not compat:
        raise ValueError(f"unknown method {method!r}")
    return rule_roles(features)


def random_walks(vertices: DataFrame, edges: DataFrame, length: int, walks: int, seed: int = 42) -> DataFrame:
    """``(walk, path array<string>)``: ``walks`` uniform walks of ``length`` nodes from each node, steps chosen by hash.

    A step is one join with each node's neighbour list, kept by position, so a hub's list is never gathered.
    """
    adj = adjacency(edges)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    listed = stored(adj.select("src", "dst", place.alias("i")))
    counts = listed.groupBy("src").agg(F.count("*").alias("n"))
    now = vertices.select("person_id", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"))
    now = now.select(F.concat_ws("/", "person_id", "w").alias("walk"), F.col("person_id").alias("at"), F.array(F.col("person_id").cast("string")).alias("path"))
    for step in range(1, length):
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(step)), F.col("n"))
        chosen = now.join(counts, now["at"] == counts["src"], "left").withColumn("i", pick).drop("src", "n")
        now = chosen.join(listed, (chosen["at"] == listed["src"]) & (chosen["i"] == listed["i"]), "left")
        now = now.select("walk", F.coalesce("dst", "at").alias("at"), F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.col("dst").cast("string")))).alias("path"))
        if step % 8 == 0:
            now = stored(now)
    return now.select("walk", "path")


def node_embeddings(vertices: DataFrame, edges: DataFrame, dim: int = 64, length: int = 30, walks: int = 200, window: int = 10, seed: int = 42) -> DataFrame:
    """``(person_id, embedding array<float>)`` by skip-grams over random walks; the model holds dim numbers for each node."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = stored(random_walks(vertices, edges, length, walks, seed))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, maxIter=1, seed=seed, inputCol="path", outputCol="v", numPartitions=max(1, paths.sparkSession.sparkContext.defaultParallelism)).fit(paths)
    return model.getVectors().select(F.col("word").cast("long").alias("person_id"), vector_to_array("vector", "float32").alias("embedding"))


def flat_embeddings(embeddings: DataFrame, dim: int) -> DataFrame:
    """``emb_0`` and so on, for a sink."""
    return embeddings.select("person_id", *[F.col("embedding")[i].alias(f"emb_{i}") for i in range(dim)])
