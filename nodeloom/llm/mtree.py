"""Exact top-k by inner product over integer vectors, in M-trees.

Vectors are dealt into blocks around pivots; a query's own block gives it a bound, and it meets another block only if
the block's ball may hold a better score. Every block is an M-tree of paged nodes: an entry of an inner node has a routing vector, the covering radius
of its page and the distance to the routing vector of the node above; an entry of a leaf has a vector and that distance.
Search takes pages best first by a bound of the inner product,

    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + most |x|^2 of the page - max(0, d(q, p) - radius)^2) / 2,

and stops at a page whose bound is below the k-th score so far. Before a distance to an entry is computed, the stored
distance to the routing vector above gives |d(q, parent) - d(parent, entry)| <= d(q, entry), which often rules it out.
Distances are floating-point; bounds are widened by SLACK, and scores are integers, so results are exact.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.vector_blocks import Kind, first_of_each, search, usable

PAGE, FANOUT = 128, 64
SLACK = 1e-6


def integers(data: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * data)


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over the rows of ``vectors`` as flat arrays.

    Node 0 is the root. Node i holds entries start[i]..start[i+1]; an inner node's entries name child nodes, a leaf's
    rows. Pages split by the nearest of FANOUT routing vectors at most, chosen far from each other; rows that all coincide, or
    that one routing vector would take whole, are dealt evenly.
    """
    norms = (vectors**2).sum(1)
    nodes: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def page(rows: np.ndarray, route: int) -> int:
        """Makes the node of ``rows`` whose routing vector is the row ``route`` and returns its number."""
        at = len(nodes)
        nodes.append(None)
        if len(rows) <= PAGE:
            away = np.sqrt(((vectors[rows] - vectors[route]) ** 2).sum(1))
            nodes[at] = (True, rows, away, np.zeros(len(rows)), norms[rows])
            return at
        chosen = [int(rows[0])]
        nearest = ((vectors[rows] - vectors[rows[0]]) ** 2).sum(1)
        owner = np.zeros(len(rows), np.int64)
        many = min(FANOUT, -(-2 * len(rows) // PAGE))
        while len(chosen) < many and nearest.max() > 0:
            chosen.append(int(rows[nearest.argmax()]))
            own = ((vectors[rows] - vectors[chosen[-1]]) ** 2).sum(1)
            owner[own < nearest] = len(chosen) - 1
            nearest = np.minimum(nearest, own)
        if len(chosen) < 2 or np.bincount(owner).max() > 0.9 * len(rows):
            owner = np.arange(len(rows)) % many
            chosen = [int(rows[i]) for i in range(many)]
        children, away, radius, most = [], [], [], []
        for i, c in enumerate(chosen):
            own = rows[owner == i]
            if len(own):
                children.append(page(own, c))
                away.append(np.sqrt(((vectors[c] - vectors[route]) ** 2).sum()))
                radius.append(np.sqrt(((vectors[own] - vectors[c]) ** 2).sum(1).max()))
                most.append(norms[own].max())
                routes[children[-1]] = c
        nodes[at] = (False, np.array(children), np.array(away), np.array(radius), np.array(most))
        return at

    routes: dict[int, int] = {0: 0}
    page(np.arange(len(vectors)), 0)
    return {
        "leaf": np.array([n[0] for n in nodes]),
        "start": np.cumsum([0, *(len(n[1]) for n in nodes)]),
        "entry": np.concatenate([n[1] for n in nodes]).astype(np.int64),
        "away": np.concatenate([n[2] for n in nodes]),
        "radius": np.concatenate([n[3] for n in nodes]),
        "most": np.concatenate([n[4] for n in nodes]),
        "route": np.array([routes[i] for i in range(len(nodes))]),
    }


class Tree:
    def __init__(self, vectors: np.ndarray, parts: dict[str, np.ndarray]):
        self.vectors = vectors
        self.leaf, self.start, self.entry = parts["leaf"].tolist(), parts["start"].tolist(), parts["entry"]
        self.away, self.radius, self.most, self.route = parts["away"], parts["radius"], parts["most"], parts["route"]
        self.computed = 0  # distances

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """(-score, id) of the k best rows whose id is not ``own`` and whose score is ``least`` or more, best first."""
        _, found, scores = self.tops(query[None, :], k, ids, np.array([own]), np.array([least]))
        return list(zip((-scores).tolist(), found.tolist(), strict=True))

    def tops(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of what ``top`` gives for each query.

        Queries go through the tree together: a page is taken when its highest bound for any of them comes first, and by
        those whose own bound for it is not below their own k-th score so far.
        """
        m = len(queries)
        norm = (queries**2).sum(1)
        worst, best = least.astype(np.float64), np.full((m, k), -np.inf)
        every = np.arange(m)
        squares = (self.vectors[self.route] ** 2).sum(1)
        first = np.sqrt(((queries - self.vectors[self.route[0]]) ** 2).sum(1))
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(every[:0], ids[:0], norm[:0])]
        heap = [(-np.inf, 0, every, np.full(m, np.inf), first)]
        while heap:
            _, node, at, bound, above = heapq.heappop(heap)
            left = bound >= worst[at]
            at, above = at[left], above[left]
            span = slice(self.start[node], self.start[node + 1])
            entry, radius, most = self.entry[span], self.radius[span], self.most[span]
            # what the stored distances alone allow
            low = np.maximum(0.0, np.abs(above[:, None] - self.away[span]) - radius) * (1 - SLACK)
            open_ = (norm[at, None] + most - low**2) / 2 + (SLACK * norm[at, None] + 1) >= worst[at, None]
            columns = np.flatnonzero(open_.any(axis=0))
            if not len(columns):
                continue
            entry, radius, most, open_ = entry[columns], radius[columns], most[columns], open_[:, columns]
            self.computed += open_.size
            some = queries if len(at) == m else queries[at]
            if self.leaf[node]:
                scores = some @ self.vectors[entry].T
                scores[~open_ | (ids[entry] == own[at, None])] = -np.inf
                rows = np.flatnonzero((scores >= worst[at, None]).any(axis=1))
                scores, at = scores[rows], at[rows]
                both = np.concatenate([best[at], scores], axis=1)
                best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                worst[at] = np.maximum(worst[at], best[at].min(axis=1))
                i, j = np.nonzero((scores >= worst[at, None]) & (scores > -np.inf))
                hits.append((at[i], ids[entry[j]], scores[i, j]))
                continue
            distance = np.sqrt(np.maximum(0.0, norm[at, None] + squares[entry] - 2 * (some @ self.vectors[self.route[entry]].T)))
            low = np.maximum(0.0, distance - radius) * (1 - SLACK)
            bounds = (norm[at, None] + most - low**2) / 2 + (SLACK * norm[at, None] + 1)
            open_ &= bounds >= worst[at, None]
            for j, e in enumerate(entry.tolist()):
                i = np.flatnonzero(open_[:, j])
                if len(i):
                    heapq.heappush(heap, (-float(bounds[i, j].max()), e, at[i], bounds[i, j], distance[i, j]))
        q, found, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
        good = scores >= worst[q]
        return first_of_each(q[good], found[good], scores[good], -scores[good], k)


def _open(distance, product, norms, radius, most, bounds):
    """Blocks that may hold a product as high as the bound: by the ball around the centre, from distances and from the product with it."""
    by_distance = (norms + most - (np.maximum(0.0, distance - radius) * (1 - SLACK)) ** 2) / 2
    return np.minimum(by_distance, product + np.sqrt(norms) * radius) + SLACK * (norms + most) + 1 >= bounds


def _index(data: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **build(integers(data)))
    return out.getvalue()


def _find(ids, data, index, query_ids, queries, bounds, k):
    with np.load(io.BytesIO(index)) as parts:
        tree = Tree(integers(data), dict(parts))
    q, found, scores = tree.tops(integers(queries), k, ids, query_ids, np.where(np.isnan(bounds), -np.inf, bounds))
    return query_ids[q], found, scores.astype(np.int64)


PRODUCTS = Kind(_index, integers, _find, _open, "long", True)


def top_products(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    Components become floor(1024 * x). Queries are the ids divisible by ``every``; the rows of a repeated id ask each,
    and their finds are ranked together. Candidates are all rows of ``embeddings(vec_id, embedding)`` with another id and
    as many components, all if fewer than k. Null vectors, null ids, empty vectors and vectors with a null or non-finite
    component take no part. Repeated rows are candidates each. Sums of products are
    exact while they stay below 2^53. An empty table gives an empty one; other columns are left aside.
    """
    rows = usable(embeddings).where("dim > 0")
    return search(rows.where(F.col("vec_id") % every == 0), rows, PRODUCTS, k)


ORACLE = """
WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
