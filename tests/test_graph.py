"""Closed forms on small graphs, invariants, and published figures of a 400-node network where its files are at hand."""

import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import csr, disruption, graph, iterative, links
from nodeloom.sources import tables

#: A folder with persons.csv and relations.csv of the 400-node network whose published figures are known.
NETWORK = os.environ.get("NETWORK_DIR", "")


def made(spark, n, pairs):
    v = spark.createDataFrame([(i,) for i in range(n)], "person_id bigint")
    e = spark.createDataFrame([(min(a, b), max(a, b), 1, "operational") for a, b in pairs], "from_id bigint, to_id bigint, weight int, relation_type string")
    return v, e


def column(df, name):
    return {r["person_id"]: r[name] for r in df.collect()}


def test_path(spark):
    v, e = made(spark, 5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    b = column(iterative.betweenness(v, e), "betweenness")
    assert [round(b[i] * 12, 9) for i in range(5)] == [0, 6, 8, 6, 0]
    c = column(iterative.closeness(v, e), "closeness")
    assert math.isclose(c[2], 4 / 6) and math.isclose(c[0], 4 / 10)
    assert iterative.bridges(v, e).count() == 4
    assert set(column(iterative.core_numbers(v, e), "core_number").values()) == {1}
    assert iterative.global_efficiency(v, e, None).first()["global_efficiency"] == pytest.approx(2 * (4 + 3 / 2 + 2 / 3 + 1 / 4) / 20)


def test_cycle_and_pendant(spark):
    v, e = made(spark, 5, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)])
    assert [(r.from_id, r.to_id) for r in iterative.bridges(v, e).collect()] == [(3, 4)]
    assert column(iterative.core_numbers(v, e), "core_number") == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1}


def test_load_splits_evenly(spark):
    # node 5 is reached from 0 through 3 (two ways) and through 6 (one way)
    v, e = made(spark, 7, [(0, 1), (0, 2), (1, 3), (2, 3), (0, 4), (4, 6), (3, 5), (5, 6)])
    sources = v.where("person_id = 0")
    rows = {r.person_id: (r.dependency, r.load) for r in iterative.shortest_path_flow(e, sources).collect()}
    assert rows[3] == pytest.approx((2 / 3, 1 / 2)) and rows[6] == pytest.approx((1 / 3, 1 / 2))


def test_complete_and_isolated(spark):
    v, e = made(spark, 5, [(a, b) for a in range(4) for b in range(a)])
    local = {r.person_id: r for r in graph.clustering_ego(v, e).collect()}
    assert local[0].clustering_coef == 1 and local[0].ego_density == 1 and local[0].triangles == 3
    assert local[4].clustering_coef == 0 and local[4].ego_nodes == 1 and local[4].ego_density == 0
    assert column(iterative.core_numbers(v, e), "core_number")[0] == 3
    assert column(iterative.connected_components(v, e), "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert column(graph.burt_constraint(v, e), "burt_constraint")[0] == pytest.approx(3 * (1 / 3 + 2 / 9) ** 2)


def test_empty(spark):
    v, e = made(spark, 1, [])
    assert column(iterative.betweenness(v, e), "betweenness") == {0: 0}
    assert iterative.global_efficiency(v, e).first()["global_efficiency"] == 0
    assert iterative.bridges(v, e).count() == 0
    assert column(iterative.closeness(v, e), "closeness") == {0: 0}
    assert column(graph.degree_features(v, e), "degree_centrality") == {0: 0}


def test_communities(spark):
    v, e = made(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
    persons = v.withColumn("community", (F.col("person_id") >= 3).cast("int"))
    rows = {r.person_id: r for r in graph.community_features(persons, e).collect()}
    assert rows[2].cross_community_edges == 1 and rows[2].participation_coef == pytest.approx(1 - 4 / 9)
    assert rows[0].within_module_z == pytest.approx((2 - 7 / 3) / math.sqrt(2 / 9))


def test_canonical_edges_keep_the_last(spark):
    rows = spark.createDataFrame([(2, 1, 5, "a", 0), (1, 2, 7, "b", 1), (3, 3, 1, "c", 2)], "from_id bigint, to_id bigint, weight int, relation_type string, seq int")
    assert [tuple(r) for r in graph.canonical_edges(rows, "seq").collect()] == [(1, 2, 7, "b")]


def test_removal_of_an_absent_node_takes_a_step(spark):
    v, e = made(spark, 4, [(0, 1), (1, 2)])
    order = spark.createDataFrame([("s", 1, 99), ("s", 2, 1)], "strategy string, rank int, person_id bigint")
    rows = disruption.disruption_trace(v, e, order).orderBy("step").collect()
    assert [(r.num_nodes, r.num_edges, r.num_components, r.lcc_size) for r in rows] == [(4, 2, 2, 3), (4, 2, 2, 3), (3, 0, 3, 1)]


def some_graph(n=60, m=110, seed=3):
    rng = random.Random(seed)
    return n, sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n - 4), rng.randrange(n - 4)) for _ in range(m)) if a != b})


def distances(n, pairs, source, alive):
    near = {i: {b for a, b in [*pairs, *[(y, x) for x, y in pairs]] if a == i and b in alive} for i in alive}
    seen, front, d, out = {source}, {source}, 0, {}
    while front:
        d += 1
        front = {y for x in front for y in near[x]} - seen
        seen |= front
        out |= {y: d for y in front}
    return out


def efficiency(n, pairs, alive, k, seed):
    sources = sorted(alive, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:k]
    return sum(1 / d for s in sources for d in distances(n, pairs, s, alive).values()) / (len(sources) * (len(alive) - 1)) if len(alive) > 1 else 0.0


def test_arrays_and_rows_agree(spark, monkeypatch):
    n, pairs = some_graph()
    v, e = made(spark, n, pairs)
    ways = [lambda: iterative.betweenness(v, e), lambda: iterative.betweenness(v, e, 20, 1), lambda: iterative.closeness(v, e), lambda: iterative.eigenvector(v, e, 6), lambda: iterative.global_efficiency(v, e, 10, 1), lambda: iterative.connected_components(v, e), lambda: iterative.bridge_features(v, e)]
    arrays = [sorted(map(tuple, w().collect())) for w in ways]
    monkeypatch.setattr(csr, "MOST_NODES", 0)
    for got, w in zip(arrays, ways, strict=True):
        want = sorted(map(tuple, w().collect()))
        assert len(got) == len(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("most", [1000, 0])
def test_traces_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(csr, "MOST_NODES", most)
    n, pairs = some_graph(24, 40)
    v, e = made(spark, n, pairs)
    orders = {"a": [3, 99, 5, 0, 7], "b": [1, 2]}
    df = spark.createDataFrame([(s, i, x) for s, xs in orders.items() for i, x in enumerate(xs, 1)], "strategy string, rank int, person_id bigint")
    rows = {(r.strategy, r.step): r for r in disruption.disruption_trace(v, e, df, sources=6, seed=9).collect()}
    assert len(rows) == 9
    for s, xs in orders.items():
        for step in range(len(xs) + 1):
            alive = set(range(n)) - set(xs[:step])
            parts = {frozenset({i, *distances(n, pairs, i, alive)}) for i in alive}
            r = rows[s, step]
            assert (r.num_nodes, r.num_components, r.lcc_size, r.num_edges) == (len(alive), len(parts), max(map(len, parts)), sum(a in alive and b in alive for a, b in pairs))
            assert r.global_efficiency == pytest.approx(efficiency(n, pairs, alive, 6, 9))
            assert r.efficiency_normalized == pytest.approx(efficiency(n, pairs, alive, 6, 9) / efficiency(n, pairs, set(range(n)), 6, 9))


def test_induced_and_removed(spark):
    v, e = made(spark, 5, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)])
    some = v.where("person_id in (0, 1, 3)")
    assert sorted((r.from_id, r.to_id) for r in graph.induced(e, some).collect()) == [(0, 1), (0, 3)]
    assert sorted((r.from_id, r.to_id) for r in graph.without(e, v.where("person_id = 3")).collect()) == [(0, 1), (1, 2)]


@pytest.mark.skipif(not os.path.isdir(NETWORK), reason="the network's files are not here")
def test_published_degree_curve(spark):
    net = tables.read_network(spark, NETWORK).kept()
    assert (net.vertices.count(), net.relations.count()) == (400, 1229)
    order = disruption.removal_order(graph.degrees(net.vertices, net.relations), "Degree", "degree", 150)
    row = disruption.summarise(disruption.disruption_trace(net.vertices, net.relations, order)).first()
    assert row["Steps_to_50%_LCC"] == 98 and row["AUC_LCC"] == pytest.approx(98.6343490304709, abs=1e-9)
    assert iterative.bridges(net.vertices, net.relations).count() == 93
    cores = {r.core_number: r.n for r in iterative.core_numbers(net.vertices, net.relations).groupBy("core_number").agg(F.count("*").alias("n")).collect()}
    assert cores == {0: 37, 1: 94, 2: 76, 3: 44, 4: 39, 5: 15, 6: 8, 7: 5, 8: 2, 9: 9, 10: 71}


def test_array_kernels_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(csr, "SLOTS", 3)
    monkeypatch.setattr(csr, "CHUNK", 32)
    n, pairs = some_graph(90, 160, 5)
    v, e = made(spark, n, pairs)
    g = csr.compact(v, e)
    far = [distances(n, pairs, i, set(range(n))) for i in range(n)]
    rows = {r.person_id: r for r in csr.distance_sums(spark, g).collect()}
    assert len(rows) == n
    for i, d in enumerate(far):
        assert (rows[i].reached, rows[i].total) == (len(d), sum(d.values())) and rows[i].inverse == pytest.approx(sum(1 / x for x in d.values()))
    # cores by taking nodes away one by one; bridges by taking edges away one by one
    near, core, k = {i: {b for a, b in [*pairs, *[(y, x) for x, y in pairs]] if a == i} for i in range(n)}, {}, 0
    while near:
        least = min(near, key=lambda i: len(near[i]))
        k = max(k, len(near[least]))
        core[least] = k
        for y in near.pop(least):
            near[y].discard(least)
    assert csr.cores(g).tolist() == [core[i] for i in range(n)]
    cut = {(a, b) for a, b in pairs if b not in distances(n, [p for p in pairs if p != (a, b)], a, set(range(n)))}
    assert {tuple(sorted(p)) for p in zip(*(x.tolist() for x in csr.bridge_ends(g)), strict=True)} == cut


def test_cores_settle_beyond_the_rounds_of_the_sql(spark):
    # a path's values fall by one node a round from its ends, so forty rounds leave its middle at 2
    v, e = made(spark, 101, [(i, i + 1) for i in range(100)])
    assert set(column(iterative.core_numbers(v, e), "core_number").values()) == {1}
    assert csr.MOST_EDGES >= 8_000_000


def test_enclosing_sizes_and_wedges_agree_with_rows(spark, monkeypatch):
    monkeypatch.setattr(csr, "CHUNK", 40)
    n, pairs = some_graph(40, 70, 8)
    v, e = made(spark, n, pairs)
    asked = spark.createDataFrame([*pairs[:30], (0, 39), (38, 39)], "from_id bigint, to_id bigint")
    want = {tuple(r) for r in links.enclosing_subgraphs(e, asked, 2).select("from_id", "to_id", "n_nodes", "n_edges").collect()}
    assert {tuple(r) for r in links.enclosing_sizes(v, e, asked, 2).collect()} == want
    full = links.link_scores(v, e, links.candidates(e)).select("from_id", "to_id", "common_neighbours")
    assert {tuple(r) for r in links.wedge_counts(e).collect()} == {tuple(r) for r in full.collect()}


def test_graph_is_built_and_sent_once(spark):
    """The features of one network share its arrays, which are not read from Spark again, and another table is another graph."""
    from nodeloom.operators.store import stored

    v = spark.range(6).withColumnRenamed("id", "person_id")
    e = stored(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "from_id long, to_id long"))
    g = csr.compact(v, e)
    assert csr.compact(v, e) is g and csr._sent(spark, g) is csr._sent(spark, g)
    assert {r.person_id: r.core_number for r in iterative.core_numbers(v, e).collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
    assert [tuple(r) for r in iterative.bridges(v, e).collect()] == [(2, 3)]
    other = csr.compact(v, stored(e.where("to_id < 3")))
    assert other is not g and len(other.to) == 6
    assert csr.compact(v, e.where("to_id < 3")) is not other
    far = csr.compact(spark.createDataFrame([(5,), (1 << 40,)], "person_id long"), spark.createDataFrame([(5, 1 << 40)], "from_id long, to_id long"))
    assert far.ids.tolist() == [5, 1 << 40] and far.to.tolist() == [1, 0]


def test_one_measure_alone(spark, monkeypatch):
    rng = random.Random(4)
    v, e = made(spark, 40, {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    both = iterative.betweenness(v, e)
    b, load = column(both, "betweenness"), column(both, "load_centrality")
    for most in (csr.MOST_EDGES, 0):  # as arrays and as rows
        monkeypatch.setattr(csr, "MOST_EDGES", most)
        for name, want in (("betweenness", b), ("load_centrality", load)):
            own = iterative.betweenness(v, e, only=name)
            assert own.columns == ["person_id", name] and column(own, name) == pytest.approx(want)
    with pytest.raises(ValueError):
        iterative.betweenness(v, e, only="degree")


def test_more_searches_at_once_in_small_graphs(spark, monkeypatch):
    assert csr.words_at_once(120_000, 6) == 32 and csr.words_at_once(1_200_000, 6) == csr.words_at_once(2000, 6) == 8
    rng = random.Random(5)
    v, e = made(spark, 700, {tuple(sorted(rng.sample(range(700), 2))) for _ in range(1500)})
    found = []
    for words in (1, 11):
        monkeypatch.setattr(csr, "words_at_once", lambda n, cores, words=words: words)
        found.append(column(iterative.closeness(v, e), "closeness"))
    assert found[0] == pytest.approx(found[1])
