"""Incidents, scores, metrics, links, models, files and the generator on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import csr, disruption, features, links, metrics, models, subgraph_net
from nodeloom.operators.store import percentiles, ranked, stored, sums_before
from nodeloom.plans import diagnostics
from nodeloom.sources import synthetic, tables
from nodeloom.streaming import events


def test_participants(spark):
    people = spark.createDataFrame([(i,) for i in range(4)], "person_id bigint")
    rows = [(1, "Arson", "Peripheral", "Low", "0;1"), (2, "Fraud", "Broker", "Severe", "1; ;2"), (3, "Fraud", None, "High", "x;2;2")]
    table = spark.createDataFrame(rows, "incident_id bigint, crime_type string, modus_operandi string, severity string, persons_involved string")
    got = {r.person_id: (r.incident_count, r.crime_diversity, r.avg_severity, r.broker_interactions, r.peripheral_interactions) for r in features.behaviour_features(people, table).collect()}
    assert got == {0: (1, 1, 1.0, 0, 1), 1: (2, 2, 2.5, 1, 1), 2: (3, 1, pytest.approx(10 / 3), 1, 2), 3: (0, 0, 0.0, 0, 0)}
    with pytest.raises(Exception, match="unknown severity"):
        features.behaviour_features(people, table.withColumn("severity", F.lit("Odd"))).collect()


def test_scores_are_scaled(spark):
    rows = [(i, ("Coordinator", "Broker", "Enabler", "Peripheral")[i % 4], i / 40, i / 100, i) for i in range(40)]
    f = spark.createDataFrame(rows, "person_id bigint, predicted_role string, betweenness double, eigenvector double, degree bigint").withColumn("true_role", F.col("predicted_role"))
    for variant in ("v0", "v1", "v2", "v3"):
        s = [r[0] for r in features.importance_scores(f, variant).select("mo_importance_score").collect()]
        assert min(s) >= 0 and max(s) == pytest.approx(1) and len(s) == 40
    with pytest.raises(ValueError):
        features.importance_scores(f, "v9")


def test_ranking_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    auc, ap = subgraph_net.auc_ap(np.array([y for _, y in rows]), np.array([s for s, _ in rows]))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(auc) == pytest.approx(5.5 / 6)
    assert metrics.average_precision(df).first()["ap"] == pytest.approx(ap)
    assert metrics.roc_auc(df.where("label = 1")).first()["auc"] == 0.5


def test_agreement(spark):
    same = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 2, "true_role string, predicted_role string")
    assert tuple(metrics.ari_nmi(metrics.confusion_matrix(same)).first()) == pytest.approx((1, 1))
    report = metrics.role_report(metrics.confusion_matrix(same.withColumn("predicted_role", F.col("true_role"))))
    assert metrics.weighted_f1(report).first()["weighted_f1"] == 1


def test_split_sizes():
    assert links.split_sizes(1229, 1200) == {"test": 245, "val": 122, "train": 862}


def test_robust_scaling_without_spread(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 5.0, 5.0, 5.0, 9.0])], "person_id bigint, x double")
    assert sorted(r.x for r in features.robust_scaled(df, ["x"]).collect()) == [0, 0, 0, 0, 4]


def test_density_clusters():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    labels = models.hdbscan_labels(points, 10, 0.5)
    assert len(set(labels) - {-1}) == 3 and all(len(set(labels[i : i + 20]) - {-1}) == 1 for i in (0, 20, 40))


def test_unknown_method(spark):
    f = spark.createDataFrame([(1, 0.1)], "person_id bigint, betweenness double")
    with pytest.raises(ValueError):
        models.infer_roles(f, f, "clustering")
    assert models.infer_roles(f, f, "clustering", compat=True).first()["predicted_role"] == "Peripheral"


def test_improvements(spark):
    rows = [("Degree (Original)", 98.0), ("Betweenness (Original)", 82.0), ("Betweenness (SEAL)", 81.0)]
    got = {r[0]: r[2] for r in disruption.improvements(spark.createDataFrame(rows, "Strategy string, `Steps_to_50%_LCC` double")).collect()}
    assert got == {"Degree (Original)": 0, "Betweenness (SEAL)": pytest.approx(17.346938775510203)}
    assert disruption.improvements(spark.createDataFrame(rows[1:], "Strategy string, `Steps_to_50%_LCC` double")).count() == 0


def test_generated_network(spark):
    net = synthetic.generate(spark)
    n, m = net.persons.count(), net.relations.count()
    assert n == 400 and 0.015 <= 2 * m / (n * (n - 1)) <= 0.05
    counts = {r.role: r["count"] for r in net.persons.groupBy("role").count().collect()}
    assert counts == {"Coordinator": 30, "Broker": 51, "Enabler": 81, "Peripheral": 238}
    assert net.incidents.count() == 1300 and net.relations.where("from_id >= to_id").count() == 0
    noisy = synthetic.add_noise(net).relations
    assert noisy.where("relation_type = 'noise'").count() == int(0.01 * m) and noisy.count() < m
    found = diagnostics.report(diagnostics.check_roles(features.role_distribution(net.persons)))
    assert found.first()["passed"] is not None and diagnostics.recommendations(found).columns == ["check", "issue", "advice"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "Broker", 0, 30)], tables.SCHEMAS["persons"])
    tables.write_csv(df, f"{tmp_path}/persons.csv")
    assert tables.read_csv(spark, f"{tmp_path}/persons.csv", tables.SCHEMAS["persons"]).collect() == df.collect()
    assert tables.read_optional(spark, f"{tmp_path}/none.csv") is None
    store = tables.PhaseStore(spark, str(tmp_path), {"seed": 1})
    made = []
    for _ in range(2):
        store.once("p1", ["t"], lambda: made.append(1) or {"t": df})
    assert made == [1] and not tables.PhaseStore(spark, str(tmp_path), {"seed": 2}).done("p1", ["t"])
    tables.save_weights(spark, [np.eye(2)], f"{tmp_path}/w")
    assert np.array_equal(tables.load_weights(spark, f"{tmp_path}/w")[0], np.eye(2))


def test_every_positive_has_a_negative(spark):
    persons = spark.range(1, 61).withColumnRenamed("id", "person_id")
    hub = [(1, i) for i in range(2, 61)] + [(2, i) for i in range(3, 58)] + [(i, i + 1) for i in range(10, 40)]  # 1 is joined to all, 2 to all but three
    for pairs in (hub, [(i, j) for i in range(1, 61) for j in range(i + 1, 61)]):
        edges = spark.createDataFrame(pairs, "from_id long, to_id long")
        split = edges.withColumn("split", F.when(F.col("to_id") % 3 == 0, "test").otherwise("train"))
        found = links.negative_samples(persons, edges, split, 42)
        rows = [(r.from_id, r.to_id) for r in found.collect()]
        assert len(rows) == len(pairs) and all(1 <= u < v <= 60 for u, v in rows)
        if pairs is hub:
            assert not set(rows) & set(pairs)
            assert {(2, 58), (2, 59), (2, 60)} <= set(rows)
        assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}


def test_density_clusters_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6), (12, 3))] + [np.zeros((20, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "person_id long, degree double, betweenness double")
    for name, value in (("MOST_POINTS", 50), ("BLOCK", 64), ("STRIP", 100)):
        monkeypatch.setattr(models, name, value)
    edges = models.spanning_tree(spark, points)
    assert len(edges) == len(points) - 1 and sum(e[0] for e in edges) == pytest.approx(sum(e[0] for e in models.dense_tree(points)))
    got = {r.person_id: r.cluster for r in models.hdbscan_clusters(df, ["degree", "betweenness"], 10, 0.5).collect()}
    want = models.hdbscan_labels(points, 10, 0.5).tolist()
    assert len(set(want) - {-1}) == 5 and len(set(zip((got[i] for i in range(len(points))), want, strict=True))) == len(set(want))

    def none(*_):
        raise AssertionError("k-means in place of density clusters")

    monkeypatch.setattr(models, "kmeans_clusters", none)
    persons = spark.range(len(points)).select(F.col("id").alias("person_id"), F.lit("Broker").alias("role"))
    roles = models.infer_roles(df, persons, "enhanced_clustering").collect()
    assert len(roles) == len(points)


def test_spanning_tree_is_the_only_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = np.column_stack([rng.exponential(size=400), rng.integers(0, 4, 400), rng.integers(0, 3, 400)])
    points = np.concatenate([points, points[:60], rng.integers(0, 5, (200, 3)) + 9.0])
    monkeypatch.setattr(models, "BLOCK", 16)
    i, j = np.triu_indices(len(points), 1)
    d = sum((points[i, k] - points[j, k]) ** 2 for k in range(3))
    root, want = list(range(len(points))), []
    for e in np.lexsort((j, i, d)):
        if root[i[e]] != root[j[e]]:
            a, b = root[i[e]], root[j[e]]
            root = [a if r == b else r for r in root]
            want.append((float(np.sqrt(d[e])), int(i[e]), int(j[e])))
    assert sorted(models.spanning_tree(spark, points)) == sorted(want)


def test_blocks_meet_near_blocks_only(monkeypatch):
    points = np.random.default_rng(2).normal(size=(6000, 4))
    order = models._dealt(points, 64)
    blocks, pairs = models._Blocks(points[order], order, 64, 256), []
    whole = models._squares
    monkeypatch.setattr(models, "_squares", lambda x, y: pairs.append(len(x) * len(y)) or whole(x, y))
    found = np.concatenate([blocks.nearest(at, 3) for at in range(len(blocks.low))])
    assert sum(pairs) < len(points) ** 2 / 3
    for at in range(0, 6000, 500):
        own = whole(points[order][at : at + 1], points[order])[0]
        assert sorted(own[found[at]]) == sorted(own)[1:4]


def test_deep_hierarchy_of_density_clusters():
    n = 30_000  # threes, each farther from the ones before: a hierarchy of 10,000 levels
    edges = [(1.0 if b % 3 else 2.0 + b, b - 1, b) for b in range(1, n)]
    labels = models.leaf_labels(n, edges, 3, 0.5)
    assert np.ptp(labels.reshape(-1, 3), axis=1).max() == 0 and len(set(labels.tolist())) == n // 3


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(2)
    x = [*rng.normal(size=400).round(1).tolist(), None]
    df = spark.createDataFrame([(i, v, 1.0 if v is None else 5.0) for i, v in enumerate(x)], "person_id long, x double, y double").repartition(5)
    rows = ranked(df, "x", "person_id").collect()
    assert [r.person_id for r in sorted(rows, key=lambda r: r["rank"])] == sorted(range(401), key=lambda i: (x[i] is not None, x[i] or 0, i)) and {r["rank"] for r in rows} == set(range(401))
    got = percentiles(df, ["x", "y"], [0.05, 0.5, 0.98])
    assert got["x"] == pytest.approx(np.percentile(x[:400], [5, 50, 98])) and got["y"] == pytest.approx(np.percentile([5.0] * 400 + [1.0], [5, 50, 98]))
    assert percentiles(df.where("false"), ["x"], [0.5]) == {"x": [None]}
    sums = {r.person_id: r.s for r in sums_before(df.where("person_id < 9"), [F.desc("person_id")], {"s": F.col("person_id")}).collect()}
    assert sums == {i: sum(range(i + 1, 9)) for i in range(9)}


def test_checks_and_their_failures(spark):
    history = spark.createDataFrame([(i, 0.1, 0.1, 0.5 + 0.004 * min(i, 8), 0.5) for i in range(1, 13)], "epoch int, train_loss double, val_loss double, val_auc double, val_ap double")

    def broken():
        raise OSError("no table")

    got = {r.check: (r.passed, r.issues) for r in diagnostics.run_checks(spark, {"links": lambda: diagnostics.check_links(history, 4), "gone": broken}).collect()}
    assert got == {"links": (False, ["AUC under 0.55", "AUC does not improve after 10 epochs", "subgraphs under 5 nodes"]), "gone": (False, ["check failed: OSError"])}
    band = spark.createDataFrame([(0.7,), (0.61,), (0.5,), (0.1,)], "v double").select(diagnostics.quality_band(F.col("v"), "f1").alias("b"))
    assert [r.b for r in band.collect()] == ["excellent", "good", "fair", "poor"]
    f = spark.createDataFrame([(i, float(i), 2.0) for i in range(4)], "person_id long, betweenness double, degree double")
    people = spark.createDataFrame([(i, ("Coordinator", "Peripheral")[i % 2]) for i in range(4)], "person_id long, role string")
    rows = {(r.role, r.feature): (r["mean"], r.std) for r in diagnostics.separability(f, people).collect()}
    assert rows["Coordinator", "betweenness"] == pytest.approx((1.0, 2**0.5)) and rows["Peripheral", "degree"] == (2.0, 0.0)
    assert not diagnostics.check_separability(f, people).first()["passed"]


def test_improvement_matrix(spark):
    rows = [("Degree (Original)", 100.0, 50.0), ("Random (SEAL)", 150.0, 40.0)]
    summary = spark.createDataFrame(rows, "Strategy string, `Steps_to_50%_LCC` double, `Steps_to_50%_Efficiency` double")
    assert [tuple(r) for r in disruption.improvement_matrix(summary).collect()] == [("Random (SEAL)", -50.0, 20.0)]
    assert disruption.improvement_matrix(summary.where("false")).count() == 0
    assert {tuple(r) for r in disruption.side_by_side(summary).collect()} == {("Degree", 100.0, None), ("Random", None, 150.0)}


def test_models_are_kept(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, ("Broker", "Enabler")[i % 2], float(i % 2) + float(rng.normal(0, 0.1)), float(rng.normal())) for i in range(80)]
    f = spark.createDataFrame(rows, "person_id long, role string, a double, b double")
    model, roles, (mean, std) = models.supervised_roles(f, f, ["a", "b"], trees=5, depth=4, folds=3)
    assert mean > 0.95 and 0 <= std < 0.1 and roles.count() == 80
    assert [c for _, c, _ in models.importances(model, ["a", "b"])] == ["a", "b"]
    tables.save_model(model, f"{tmp_path}/m")
    weighted = f.withColumn("weight", F.lit(1.0))
    again = tables.load_model(f"{tmp_path}/m").transform(weighted).select("person_id", "predicted_role").collect()
    assert sorted(again) == sorted(model.transform(weighted).select("person_id", "predicted_role").collect())
    net, other = (subgraph_net.Net(3, subgraph_net.Settings(hidden=4, top=2, seed=s)) for s in (1, 2))
    net.step([np.ones_like(p) for p in net.p])
    tables.save_training(spark, net, 7, 0.75, f"{tmp_path}/t")
    assert tables.load_training(spark, other, f"{tmp_path}/t") == (7, 0.75) and other.t == 1
    assert all(np.array_equal(x, y) for one, two in ((net.p, other.p), (net.m, other.m), (net.v, other.v)) for x, y in zip(one, two, strict=True))


def test_subgraphs_are_kept_by_graph(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "from_id long, to_id long")
    more = edges.unionByName(spark.createDataFrame([(1, 3)], "from_id long, to_id long"))
    ask = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    sizes = [tables.cached_subgraphs(spark, str(tmp_path), e, "test", lambda e=e: links.enclosing_subgraphs(e, ask, 2)).first()["n_edges"] for e in (edges, more, edges)]
    assert sizes == [2, 3, 2] and tables.fingerprint(edges) == tables.fingerprint(edges.orderBy(F.desc("from_id")))
    assert tables.preview(links.enclosing_subgraphs(edges, ask, 2)).first()["nodes_size"] == 3


def test_subgraph_network_scores_every_pair(spark):
    net = synthetic.generate(spark)
    split = links.edge_split(net.relations, 1, 60).where("split <> 'val' OR from_id % 3 = 0")
    pairs = split.withColumn("label", F.lit(1)).unionByName(links.negative_samples(net.vertices, net.relations, split, 1).withColumn("label", F.lit(0))).where("split = 'train' OR from_id % 5 = 0")
    settings = subgraph_net.Settings(hidden=8, epochs=2, fit_rows=20, stop_rows=10)
    inputs = links.node_inputs(net.vertices, net.relations, None, 4)
    model, history, _ = subgraph_net.train(links.subgraph_inputs(net.relations, subgraph_net.fit_pairs(pairs, settings), inputs, 1), settings)
    rows = links.subgraph_inputs(net.relations, pairs, inputs, 1)
    got = subgraph_net.scored(model, rows).collect()
    assert len(got) == pairs.count() and len(history) <= 2
    one = rows.first()
    want = model.forward(np.array(one.x, float), subgraph_net.Net.normal(len(one.x), np.array([(e.i, e.j) for e in one.edge_index])))[0]
    assert next(r.score for r in got if (r.from_id, r.to_id, r.label) == (one.from_id, one.to_id, one.label)) == pytest.approx(want)


def test_subgraph_network_over_arrays(spark, monkeypatch):
    ends = {(int(min(e)), int(max(e))) for e in np.random.default_rng(4).integers(1, 60, (90, 2)) if e[0] != e[1]}
    vertices, relations = spark.range(1, 61).withColumnRenamed("id", "person_id"), stored(spark.createDataFrame(sorted(ends), "from_id long, to_id long"))
    pairs = stored(links.edge_split(relations, 1).withColumn("label", (F.col("to_id") % 2).cast("int")))
    settings = subgraph_net.Settings(hidden=8, epochs=3, fit_rows=30, stop_rows=10)
    inputs = stored(links.node_inputs(vertices, relations, None, 4))
    fit = stored(subgraph_net.fit_pairs(pairs, settings))

    def dense(*_):
        raise AssertionError("a matrix of all pairs of a subgraph's nodes")

    monkeypatch.setattr(subgraph_net.Net, "normal", staticmethod(dense))
    rows, history, _ = subgraph_net.train(links.subgraph_inputs(relations, fit, inputs).orderBy("split", "from_id", "to_id", "label"), settings)
    graph = csr.compact(vertices, relations)
    held = subgraph_net.held_inputs(spark, graph, inputs)
    model, other, _ = subgraph_net.fitted(spark, graph, held, fit, settings)
    assert np.allclose(history.to_numpy(), other.to_numpy()) and all(np.allclose(a, b) for a, b in zip(rows.p, model.p, strict=True))
    want = {tuple(r)[:4]: r.score for r in subgraph_net.scored(model, links.subgraph_inputs(relations, pairs, inputs)).collect()}
    got = {tuple(r)[:4]: r.score for r in subgraph_net.scored_over(spark, graph, held, model, pairs).collect()}
    assert len(got) == pairs.count() and got == pytest.approx(want)


def test_subgraph_network_fits_every_pair(spark, monkeypatch):
    """The fit reads all train and val pairs; over shards it is the same from the graph as arrays and from rows, and one shard is the fit in one task."""
    ends = {(int(min(e)), int(max(e))) for e in np.random.default_rng(4).integers(1, 400, (900, 2)) if e[0] != e[1]}
    vertices, relations = spark.range(1, 401).withColumnRenamed("id", "person_id"), stored(spark.createDataFrame(sorted(ends), "from_id long, to_id long"))
    pairs = stored(links.edge_split(relations, 1).withColumn("label", (F.col("to_id") % 2).cast("int")))
    settings = subgraph_net.Settings(hidden=8, epochs=2)
    fit = subgraph_net.fit_pairs(pairs, settings)
    assert fit.where("split = 'train'").count() == pairs.where("split = 'train'").count() > 400 and fit.where("split = 'val'").count() == pairs.where("split = 'val'").count()
    inputs = stored(links.node_inputs(vertices, relations, None, 4))
    graph = csr.compact(vertices, relations)
    held = subgraph_net.held_inputs(spark, graph, inputs)
    one, history, _ = subgraph_net.fitted(spark, graph, held, fit, settings)
    net, same = subgraph_net.fitted_pairs(spark, graph, held, fit, settings)
    assert np.allclose(history.to_numpy(), same.to_numpy()) and all(np.allclose(a, b) for a, b in zip(one.p, net.p, strict=True))
    monkeypatch.setattr(subgraph_net, "SHARD", len(ends) // 8)
    net, history = subgraph_net.fitted_pairs(spark, graph, held, fit, settings)
    again, other = subgraph_net.fitted_rows(stored(links.subgraph_inputs(relations, fit, inputs)), 4, settings)
    assert np.allclose(history.to_numpy(), other.to_numpy()) and all(np.allclose(a, b) for a, b in zip(net.p, again.p, strict=True))


def test_subgraph_network_slopes():
    """The summed gradients of a batch are the slopes of its loss."""
    rng = np.random.default_rng(6)
    rows = []
    for n, m, y in ((5, 6, 1.0), (9, 14, 0.0), (1, 0, 1.0)):
        e = rng.integers(0, n, (m, 2))
        e = e[e[:, 0] != e[:, 1]]
        rows.append((rng.normal(size=(n, 3)), subgraph_net.Near(n, np.concatenate([e, e[:, ::-1]])), y))
    net, part = subgraph_net.Net(3, subgraph_net.Settings(hidden=4, top=3)), subgraph_net.Rows(rows)
    net.p[1], net.p[3] = rng.normal(size=4), rng.normal(size=4)  # off the kinks
    loss = lambda: -sum(np.log(p if y else 1 - p) for p, y in ((net.forward(x, a)[0], y) for x, a, y in rows))
    (_, *sub), = part.pieces(np.arange(3))
    out, slopes = net.learned(*sub, part.y)
    assert np.allclose(out, [net.forward(x, a)[0] for x, a, _ in rows])
    for p, g in zip(net.p, slopes, strict=True):
        for at in np.ndindex(p.shape):
            was, h = p[at], 1e-6
            p[at] = was + h
            up = loss()
            p[at] = was - h
            down, p[at] = loss(), was
            assert g[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-7)


def test_negative_samples_send_no_edges(spark, monkeypatch):
    """Tables with a row for each edge or person are merged, however small their files: only the counts by bucket are sent."""
    plans = []
    monkeypatch.setattr(links, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    edges = stored(spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "from_id long, to_id long"))
    vertices = stored(spark.range(1, 41).withColumnRenamed("id", "person_id"))
    got = links.negative_samples(vertices, edges, stored(links.edge_split(edges, 1)))
    assert got.count() == 39 and plans and plans[0].count("BroadcastHashJoin") == 1 and "LeftAnti" in plans[0]
    assert "BroadcastHashJoin" not in plans[1]


def test_forests_add_up_in_any_order(spark):
    """Shares summed tree by tree, or part by part, give the same digits."""
    rng = np.random.default_rng(8)
    rows = [(i, ("Broker", "Enabler", "Peripheral")[int(rng.integers(3))], float(rng.normal()), float(rng.normal())) for i in range(60)]
    f = spark.createDataFrame(rows, "person_id long, role string, a double, b double")
    model, roles, _ = models.supervised_roles(f, f, ["a", "b"], trees=60, depth=6, folds=2)
    by_tree = {r.person_id: max(r.probability) for r in model.transform(f).collect()}
    assert by_tree == {r.person_id: r.confidence for r in roles.collect()}


def test_adjacency_by_neighbours():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (7, 0), (9, 12), (40, 200)):
        ends = rng.integers(0, n, (m, 2))
        index = np.concatenate([ends, ends[:, ::-1]])
        x = rng.normal(size=(n, 5))
        assert np.allclose(subgraph_net.Near(n, index) @ x, subgraph_net.Net.normal(n, index) @ x)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a", 2.0), (1, "2024-01-01 10:10:00", "a", 3.0), (1, "2024-01-01 12:00:00", "b", 1.0), (2, "2024-01-02 00:00:00", "a", 1.0)], "user_id long, at_ string, event_type string, value double")
    df = df.withColumn("ts", F.col("at_").cast("timestamp")).drop("at_")
    assert sorted((r.user_id, r.n) for r in events.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    df.write.parquet(f"{tmp_path}/e")
    query = events.tumbling(events.event_stream(spark, f"{tmp_path}/e", df.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((str(r.window_start), r.event_type, r.n, r.total) for r in rows)
    assert key(spark.table("counts").collect()) == key(events.tumbling(df).collect())


def test_tree_takes_the_best_split():
    """A node's split is the one of the highest weighted Gini gain of all that leave enough rows on both sides."""
    from nodeloom.operators import forest

    for seed in range(20):
        rng = np.random.default_rng(seed)
        x, y, weights, leaf = rng.integers(0, 40, (60, 1)).astype(float), rng.integers(0, 3, 60), np.array([0.5, 1.0, 3.0]), 4
        bins = forest.binned(x, forest.cuts_of(x))
        tree, gains = forest.grow(bins, y, weights, 1, leaf, np.random.default_rng(seed))
        times = np.random.default_rng(seed).poisson(1.0, 60)
        gini = lambda on: ((np.bincount(y[on], times[on], 3) * weights) ** 2).sum() / (np.bincount(y[on], times[on], 3) @ weights)
        found = {}
        for b in range(bins.max()):
            left = bins[:, 0] <= b
            if min(times[left].sum(), times[~left].sum()) >= leaf:
                found[b] = gini(left) + gini(~left) - gini(left | True)
        assert tree.feature.tolist() == [0, -1, -1] and np.isclose(gains[0], max(found.values())) and np.isclose(found[int(tree.split[0])], gains[0])
        left = bins[:, 0] <= tree.split[0]
        assert tree.counts.tolist() == [np.bincount(y[s], times[s], 3).tolist() for s in (left, ~left)]
        again = forest.Tree.unpacked(tree.packed()).shares(bins, weights)
        assert np.array_equal(again, tree.shares(bins, weights)) and np.allclose(again.sum(axis=1), 1)
        assert np.allclose(again[left], np.bincount(y[left], times[left], 3) * weights / (np.bincount(y[left], times[left], 3) @ weights))


def test_forests_are_grown_by_tasks(spark):
    """The 3,000 trees of the second supervised variant are one job, a fold's rows are asked of a forest that has not seen them, and the model says what the roles say."""
    from nodeloom.operators import forest

    rng = np.random.default_rng(3)
    rows = [(i, ("Broker", "Enabler", "Peripheral")[int(rng.integers(3))], float(rng.normal()), float(i)) for i in range(90)]
    f = spark.createDataFrame(rows, "person_id long, role string, a double, b double")
    model, roles, (mean, _) = models.supervised_roles(f, f, ["a", "b"], trees=40, depth=12, folds=3)
    assert isinstance(model, forest.Forest) and model.trees.count() == 40
    said = {r.person_id: r.predicted_role for r in roles.collect()}
    assert sum(said[i] == role for i, role, _, _ in rows) > 75 and mean < 0.6  # roles are noise: known rows are told, unseen ones are not
    assert {r.person_id: r.predicted_role for r in model.transform(f).collect()} == said
    again, same, _ = models.supervised_roles(f, f, ["a", "b"], trees=40, depth=12, folds=3)
    assert sorted(same.collect()) == sorted(roles.collect())
    assert models.forest_roles(f, f.select("person_id", "role"), ["a", "b"], trees=20).count() == 90


def test_starts_of_k_means_run_at_once(spark, monkeypatch):
    import threading

    from pyspark.ml.clustering import KMeans

    both, fit = threading.Barrier(2), KMeans.fit

    def met(self, *args):
        both.wait(30)
        return fit(self, *args)

    monkeypatch.setattr(KMeans, "fit", met)
    rows = spark.createDataFrame([(i, float(i % 2 * 9 + i / 100)) for i in range(20)], "person_id long, a double")
    found = {r.person_id: r.cluster for r in models.kmeans_clusters(rows, ["a"], 2, 2).collect()}
    assert len(found) == 20 and len({(i % 2, c) for i, c in found.items()}) == 2
