"""Vector searches against brute force."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import mtree, rabitq, vector_blocks


def table(spark, n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = [(i, [float(x) for x in centres[i % 4] * 0.2 + rng.normal(size=dim) * 0.1]) for i in range(n)]
    rows[7] = (7, rows[0][1])  # a copy: ties go to the smaller id
    rows += [(n, None), (n + 1, [float("nan")] * dim), (n + 2, [None] + [0.1] * (dim - 1)), (n + 3, [0.0] * dim), (n + 4, [0.5])]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")


def good(rows, zero):
    return [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 64)
    rows, df = table(spark, 420)
    vectors = [(i, np.floor(1024 * v).astype(int)) for i, v in good(rows, True)]
    want = []
    for q, a in vectors:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in vectors if i != q and len(b) == len(a))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, mtree.top_products(df).collect())) == want
    assert mtree.top_products(df.where("false")).count() == 0


def test_repeated_queries_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 8)
    monkeypatch.setattr(vector_blocks, "GROUP", 2)
    rng = np.random.default_rng(3)
    rows = [(i % 40, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(90)] + [(100, [])] * 2 + [(0, None), (None, [1.0] * 4)] + [(100, [0.5, 0.5, 0.0, 0.25])] * 2
    names = ("score", "rank", "query_id", "cell", "dim", "v", "block", "bound")
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{n} int" for n in names))
    vectors = [(i, np.array(v)) for i, v in rows if v and i is not None]
    for got, value, zero in ((mtree.top_products(df), lambda a, b: -int(np.floor(1024 * a) @ np.floor(1024 * b)), True), (rabitq.nearest(df), lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)):
        found: dict = {}
        for r in got.collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        use = [(i, v) for i, v in vectors if zero or v.any()]
        for q in {i for i, _ in use if i % 100 == 0}:
            best = sorted((value(a, b), i) for j, a in use if j == q for i, b in use if i != q)[:10]
            assert [(abs(s), i) for _, s, i in sorted(found[q])] == [(pytest.approx(abs(s)), i) for s, i in best]  # few blocks, so that the codes miss none
        assert set(found) == {i for i, _ in use if i % 100 == 0}


def test_far_blocks_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 12))
    centres /= np.sqrt((centres**2).sum(1))[:, None]
    rows = [(i, (centres[i % 8] + rng.normal(size=12) * 0.01).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    for kind in ("products", "distances"):
        got: dict = {}
        for r in (mtree.top_products(df) if kind == "products" else rabitq.nearest(df)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        whole = np.floor(1024 * x)
        for q in range(0, 1600, 100):
            s = -(whole @ whole[q]) if kind == "products" else np.sqrt(((x - x[q]) ** 2).sum(1))
            want = [i for i in np.lexsort((np.arange(1600), s)).tolist() if i != q][:10]
            own = [i for _, i in sorted(got[q])]
            assert own == want if kind == "products" else len(set(own) & set(want)) >= 9
    rows_ = vector_blocks.usable(df)
    pivots = vector_blocks.pivots_of(rows_)
    cells = vector_blocks.assigned(rows_, pivots)
    none = F.lit(None).cast("double")
    indexed = vector_blocks._indexed(vector_blocks.packed(cells.withColumn("bound", none), 50, "block", 1600), mtree.PRODUCTS)
    groups = vector_blocks.packed(cells.where("vec_id % 100 = 0").withColumn("bound", F.lit(1.04e6)), 512, "part", 16)
    opened = vector_blocks._opened(groups.select("dim", "cell", "ids", "data", "bounds"), indexed.select("dim", "cell", "block", "centre", "radius", "most"), mtree.PRODUCTS)
    visits = sum(len(r.query_ids) // 8 for r in opened.collect())
    assert visits < 0.4 * 16 * indexed.count()


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_tree_is_exact_and_avoids_distances(n):
    rng = np.random.default_rng(n)
    vectors = np.floor(rng.normal(size=(n, 8)) * 50)
    vectors[n // 2 :] = vectors[: n - n // 2]  # many copies
    tree = mtree.Tree(vectors, mtree.build(vectors))
    ids = np.arange(n)
    for q in rng.integers(0, n, 20).tolist():
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:10]
        assert tree.top(vectors[q], 10, ids, q) == want
    assert n < 3000 or tree.computed < 0.8 * 20 * n


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 128)
    rows, df = table(spark, 900, 64, 5)
    vectors = good(rows, False)
    found: dict = {}
    for r in rabitq.nearest(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, a in vectors:
        if q % 100 == 0 and len(a) == 64:
            best = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in vectors if i != q and len(b) == 64)[:10]
            own = sorted(found[q])
            assert [r for r, *_ in own] == list(range(1, 11))
            assert all(s == pytest.approx(float(np.sqrt(((a - dict(vectors)[i]) ** 2).sum())), rel=1e-12) for _, i, s in own)
            hits += len({i for _, i in best} & {i for _, i, _ in own})
            total += 10
    assert hits >= 0.9 * total
    assert rabitq.nearest(df.where("false")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(2000, 64))
    parts = rabitq.encode(data)
    inside = []
    for q in rng.normal(size=(20, 64)):
        low, high = rabitq.bounds(parts, q)
        true = ((data - q) ** 2).sum(1)
        inside.append(((low <= true) & (true <= high)).mean())
    assert np.mean(inside) > 0.9


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.top_products(df).orderBy("rank").collect()] == [(0, 1, 3, 0), (0, 2, 5, 0)]
    assert [tuple(r)[:3] for r in rabitq.nearest(df).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 5)]
    random.seed(0)


def test_queries_go_through_a_block_together():
    rng = np.random.default_rng(8)
    data = rng.normal(size=(4096, 64))
    queries, ids, own = rng.normal(size=(600, 64)), np.arange(4096), np.arange(600)
    for kind in (mtree.PRODUCTS, rabitq.DISTANCES):
        calls = []
        trace = lambda frame, event, _, calls=calls: calls.append(frame.f_code.co_name) if event == "call" else None
        index = kind.index(data)
        sys.setprofile(trace)
        try:
            q, v, s = kind.find(ids, data, index, own, queries, np.full(600, np.nan), 10)
        finally:
            sys.setprofile(None)
        assert len(calls) < 6000  # not some for each query and page
        assert np.bincount(q).tolist() == [10] * 600 and (q != v).all()
        if kind is mtree.PRODUCTS:
            scores = np.floor(1024 * queries) @ np.floor(1024 * data).T
            scores[own, own] = -np.inf
            assert np.array_equal(np.sort(scores, axis=1)[:, :-11:-1].ravel(), s)


def test_bounds_of_a_task():
    for kind, better, worse in ((mtree.PRODUCTS, [9, 8], [1, 2]), (rabitq.DISTANCES, [1.0, 2.0], [9.0, 8.0])):
        so_far = vector_blocks.Bounds(kind, 2)
        so_far.add(np.array([4, 4, 5]), np.array([*better, 3]))
        so_far.add(np.array([4, 4]), np.array(worse))
        got = so_far.of(np.array([4, 5, 6, 6]), np.array([np.nan, np.nan, np.nan, 7.0]))
        assert got[0] == better[1] and np.isnan(got[1]) and np.isnan(got[2]) and got[3] == 7.0
