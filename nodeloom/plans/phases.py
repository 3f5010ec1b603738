"""The analysis from end to end: network, features and roles, links, disruption; each phase is stored and can be skipped."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import disruption, features, graph, iterative, links, metrics, models
from nodeloom.operators.graph import Network
from nodeloom.operators.store import stored
from nodeloom.plans import diagnostics
from nodeloom.sources import synthetic
from nodeloom.sources.tables import PhaseStore


@dataclass(frozen=True)
class Settings:
    network: synthetic.Settings = field(default_factory=synthetic.Settings)
    method: str = "rules"
    score: str = "v1"
    pivots: int | None = 100
    removals: int = 150
    seed: int = 42
    embedding: int = 0
    added_links: int = 0


def with_norm(between: DataFrame, n: int) -> DataFrame:
    """``between`` with betweenness_norm: the betweenness times the (n - 1)(n - 2) / 2 pairs, 0 for two nodes at most."""
    return between.withColumn("betweenness_norm", F.col("betweenness") * ((n - 1) * (n - 2) / 2 if n > 2 else 0.0))


def structural_features(net: Network, s: Settings) -> DataFrame:
    """Structure, communities, behaviour and bridges of every person, as numbers."""
    v, e = net.vertices, net.relations
    between = with_norm(iterative.betweenness(v, e, s.pivots, s.seed), v.count())
    parts = [
        graph.degree_features(v, e), between, iterative.closeness(v, e), iterative.eigenvector(v, e), graph.clustering_ego(v, e).drop("degree", "triangles"), iterative.core_numbers(v, e),
        graph.community_features(net.persons, e), graph.burt_constraint(v, e), iterative.bridge_features(v, e),
    ]
    if net.incidents is not None:
        parts.append(features.behaviour_features(net.persons, net.incidents))
    if s.embedding:
        parts.append(models.flat_embeddings(models.node_embeddings(v, e, s.embedding), s.embedding))
    return features.feature_table(v, *parts)


def scored_features(net: Network, s: Settings) -> DataFrame:
    """The feature table with true and predicted roles, joined by id, and importance scores."""
    table = stored(structural_features(net, s))
    roles = models.infer_roles(table, net.persons, s.method)
    whole = stored(table.join(roles, "person_id").join(net.persons.select("person_id", F.col("role").alias("true_role")), "person_id"))
    return whole.join(features.importance_scores(whole, s.score), "person_id")


def link_model(net: Network, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(test metrics, augmented relations). Scores come from the training edges, so held-out ones do not leak."""
    split = stored(links.edge_split(net.relations, s.seed))
    pairs = split.withColumn("label", F.lit(1)).unionByName(links.negative_samples(net.vertices, net.relations, split, s.seed).withColumn("label", F.lit(0)))
    samples = stored(links.link_scores(net.vertices, split.where("split = 'train'"), pairs))
    model = links.train_classifier(samples)
    tested = stored(links.classified(model, samples).where("split = 'test'").select("score", "label"))
    found = None
    if s.added_links:
        some = links.link_scores(net.vertices, net.relations, links.candidates(net.relations)).withColumn("label", F.lit(0))
        found = links.classified(model, some)
    return metrics.roc_auc(tested).join(metrics.average_precision(tested)), links.augmented(net.relations, found, s.added_links, "score")


def removal_orders(net: Network, scored: DataFrame, s: Settings) -> DataFrame:
    """Degree, Betweenness, Closeness, MO-Based and Random, the first ``removals`` of each."""
    out = disruption.random_order(net.vertices, s.removals, s.seed)
    for name, column in (("Degree", "degree"), ("Betweenness", "betweenness"), ("Closeness", "closeness"), ("MO-Based", "mo_importance_score")):
        if column in scored.columns:
            out = out.unionByName(disruption.removal_order(scored, name, column, s.removals))
    return out


def run(spark: SparkSession, folder: str, s: Settings = Settings(), force: bool = False) -> dict[str, DataFrame]:
    """All phases' tables by name. A phase is read back if its tables are complete for the same settings, unless ``force`` is set."""
    store = PhaseStore(spark, folder, asdict(s))

    def network() -> dict[str, DataFrame]:
        clean = synthetic.generate(spark, s.network)
        noisy = synthetic.add_noise(clean, s.network)
        return {"persons": noisy.persons, "relations": noisy.relations, "incidents": noisy.incidents}

    p1 = store.once("network", ["persons", "relations", "incidents"], network, force)
    net = Network(p1["persons"], p1["relations"], p1["incidents"])
    p2 = store.once("features", ["scored"], lambda: {"scored": scored_features(net, s)}, force)

    def linked() -> dict[str, DataFrame]:
        quality, more = link_model(net, s)
        return {"link_metrics": quality, "augmented": more}

    p3 = store.once("links", ["link_metrics", "augmented"], linked, force)
    seal = Network(net.persons, p3["augmented"], net.incidents)

    def disrupted() -> dict[str, DataFrame]:
        orders = {"Original": stored(removal_orders(net, p2["scored"], s))}
        orders["SEAL"] = orders["Original"] if not s.added_links else stored(removal_orders(seal, scored_features(seal, s), s))
        traces = [disruption.disruption_trace(g.vertices, g.relations, orders[name], seed=s.seed).withColumn("strategy", disruption.named(F.col("strategy"), name)) for name, g in (("Original", net), ("SEAL", seal))]
        trace = stored(traces[0].unionByName(traces[1]))
        summary = stored(disruption.summarise(trace))
        return {"trace": trace, "summary": summary, "improvements": disruption.improvements(summary), "matrix": disruption.improvement_matrix(summary)}

    p4 = store.once("disruption", ["trace", "summary", "improvements", "matrix"], disrupted, force)
    roles = p2["scored"].select("person_id", "true_role", "predicted_role")
    matrix = metrics.confusion_matrix(roles)
    report = metrics.role_report(matrix)
    final = diagnostics.final_summary(metrics.weighted_f1(report), metrics.ari_nmi(matrix), p3["link_metrics"], p4["improvements"])
    quality = p3["link_metrics"].select(F.lit(1).alias("epoch"), F.lit(None).cast("double").alias("train_loss"), F.lit(None).cast("double").alias("val_loss"), F.col("auc").alias("val_auc"), F.col("ap").alias("val_ap"))
    checks = diagnostics.run_checks(spark, {
        "structure": lambda: diagnostics.check_structure(diagnostics.graph_summary(net.vertices, net.relations)), "roles": lambda: diagnostics.check_roles(features.role_distribution(net.persons)),
        "separability": lambda: diagnostics.check_separability(p2["scored"], net.persons), "inference": lambda: diagnostics.check_inference(report),
        "links": lambda: diagnostics.check_links(quality), "disruption": lambda: diagnostics.check_disruption(p4["improvements"]),
    })
    return p1 | p2 | p3 | p4 | {"role_report": report, "final": final, "checks": checks}
