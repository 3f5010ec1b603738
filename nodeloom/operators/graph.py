"""The graph of a network, and features that need a node's neighbourhood only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.store import stored


@dataclass(frozen=True)
class Network:
    """persons(person_id, name, role, community, age), relations(from_id, to_id, weight, relation_type), incidents or None.

    Vertices are all persons, so that isolated ones count.
    """

    persons: DataFrame
    relations: DataFrame
    incidents: DataFrame | None = None

    @property
    def vertices(self) -> DataFrame:
        return self.persons.select("person_id")

    def kept(self) -> Network:
        """The same with its relations written once, for operators that read them many times."""
        return Network(self.persons, stored(self.relations), self.incidents)


def canonical_edges(relations: DataFrame, order: str | None = None) -> DataFrame:
    """Undirected simple edges ``(from_id < to_id, weight, relation_type)``; loops go, the last of repeated pairs by ``order`` stays.

    Without an order the largest weight stays. A missing weight is 1.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in relations.columns else F.lit(1)
    kind = F.col("relation_type") if "relation_type" in relations.columns else F.lit(None).cast("string")
    pairs = relations.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("from_id"), F.greatest("from_id", "to_id").alias("to_id"), weight.alias("weight"), kind.alias("relation_type"), (F.col(order) if order else weight).alias("o"))
    last = F.max_by(F.struct("weight", "relation_type"), "o")
    return pairs.groupBy("from_id", "to_id").agg(last.alias("x")).select("from_id", "to_id", "x.weight", "x.relation_type")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` in both directions."""
    there = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, degree)``, 0 for isolated ones. Ends are counted before the join, so a hub is one row there."""
    counted = adjacency(edges).groupBy(F.col("src").alias("person_id")).agg(F.count("*").alias("degree"))
    return vertices.join(counted, "person_id", "left").select("person_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, degree, degree_centrality)``: degree / (n - 1), 0 for a single vertex."""
    n = vertices.agg(F.count("*").alias("n"))
    return degrees(vertices, edges).join(F.broadcast(n)).select("person_id", "degree", F.coalesce(F.try_divide(F.col("degree"), F.col("n") - 1), F.lit(0.0)).alias("degree_centrality"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(u, from_id, to_id)``: each triangle once.

    Each edge points to its end of higher degree, so a hub has few outgoing edges and the wedges stay few: at most
    m times the square root of m. A wedge is closed by an equi-join with the edges.
    """
    degree = adjacency(edges).groupBy("src").agg(F.count("*").alias("d"))
    a = degree.select(F.col("src").alias("from_id"), F.col("d").alias("da"))
    b = degree.select(F.col("src").alias("to_id"), F.col("d").alias("db"))
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("from_id") < F.col("to_id")))
    directed = edges.join(a, "from_id").join(b, "to_id").select(F.when(forward, F.col("from_id")).otherwise(F.col("to_id")).alias("u"), F.when(forward, F.col("to_id")).otherwise(F.col("from_id")).alias("v"))
    wedges = directed.alias("x").join(directed.alias("y"), F.expr("x.u = y.u AND x.v < y.v")).select(F.col("x.u").alias("u"), F.col("x.v").alias("from_id"), F.col("y.v").alias("to_id"))
    return wedges.join(edges.select("from_id", "to_id"), ["from_id", "to_id"]).select("u", "from_id", "to_id")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """``(person_id, triangles)`` of the nodes that have one."""
    return triangles(edges).select(F.explode(F.array("u", "from_id", "to_id")).alias("person_id")).groupBy("person_id").agg(F.count("*").alias("triangles"))


def clustering_ego(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, degree, triangles, clustering_coef, ego_nodes, ego_density)``.

    Clustering is 2T / (d (d - 1)), 0 below degree 2. The ego network has d + 1 nodes and d + T edges.
    """
    base = degrees(vertices, edges).join(triangle_counts(edges), "person_id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long"))
    d, t = F.col("degree"), F.col("triangles")
    return base.select(
        "person_id", "degree", "triangles",
        F.coalesce(F.try_divide(2.0 * t, d * (d - 1)), F.lit(0.0)).alias("clustering_coef"), (d + 1).alias("ego_nodes"),
        F.coalesce(F.try_divide(2.0 * (d + t), (d + 1) * d), F.lit(0.0)).alias("ego_density"),
    )


def community_features(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, same_community_degree, cross_community_edges, participation_coef, participation_coef_full, within_module_z)``.

    participation_coef is 1 - (k_same / k)^2, of the own community only; the textbook sum over all communities is
    participation_coef_full. within_module_z compares k_same with the mean and population deviation of the *total*
    degree in the community (deviation 0 counts as 1; 0 for communities of one). Isolated nodes are 0 in all of them.
    """
    community = persons.select("person_id", "community")
    ends = adjacency(edges).join(community.withColumnRenamed("person_id", "dst").withColumnRenamed("community", "other"), "dst")
    split = ends.groupBy(F.col("src").alias("person_id"), "other").agg(F.count("*").alias("k"))
    own = split.join(community, "person_id").groupBy("person_id").agg(F.sum("k").alias("degree"), F.sum(F.when(F.col("other") == F.col("community"), F.col("k")).otherwise(0)).alias("same"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    every = community.join(own, "person_id", "left").na.fill(0, ["degree", "same", "squares"])
    stats = every.groupBy("community").agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("spread"), F.count("*").alias("members"))
    k, same = F.col("degree"), F.col("same")
    spread = F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread"))
    return every.join(stats, "community").select(
        "person_id", same.cast("long").alias("same_community_degree"), (k - same).cast("long").alias("cross_community_edges"),
        F.when(k > 0, 1 - (same / k) * (same / k)).otherwise(0.0).alias("participation_coef"),
        F.when(k > 0, 1 - F.col("squares") / (k * k)).otherwise(0.0).alias("participation_coef_full"),
        F.when((k > 0) & (F.col("members") > 1), (same - F.col("mean")) / spread).otherwise(0.0).alias("within_module_z"),
    )


def burt_constraint(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(person_id, constraint, burt_constraint)``: a column that is 0, as first defined, and Burt's measure.

    Burt: the sum over neighbours j of (p_ij + sum_q p_iq p_qj)^2 with p = 1 / degree; 0 for isolated nodes. As j is a
    neighbour of i, each q closes a triangle with both, so triangles are all that has to be listed.
    """
    adj = adjacency(edges)
    share = adj.groupBy("src").agg((1.0 / F.count("*")).alias("p"))
    p = adj.join(share, "src")
    corners = F.explode(F.array(*[F.struct(F.col(i).alias("src"), F.col(j).alias("dst"), F.col(q).alias("q")) for i, j, q in itertools.permutations(("u", "from_id", "to_id"))]))
    ways = triangles(edges).select(corners.alias("t")).select("t.*").join(share, "src").join(share.select(F.col("src").alias("q"), F.col("p").alias("pq")), "q")
    indirect = ways.groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("pq")).alias("w"))
    total = p.join(indirect, ["src", "dst"], "left").select("src", F.pow(F.col("p") + F.coalesce("w", F.lit(0.0)), 2).alias("c")).groupBy("src").agg(F.sum("c").alias("c"))
    return vertices.join(total, vertices["person_id"] == total["src"], "left").select("person_id", F.lit(0.0).alias("constraint"), F.coalesce("c", F.lit(0.0)).alias("burt_constraint"))


def density(n: Column, m: Column) -> Column:
    """2m / (n (n - 1)), 0 below two nodes."""
    return F.coalesce(F.try_divide(2.0 * m, n * (n - 1)), F.lit(0.0))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(person_id)``."""
    inside = edges.join(nodes.withColumnRenamed("person_id", "from_id"), "from_id", "left_semi")
    return inside.join(nodes.withColumnRenamed("person_id", "to_id"), "to_id", "left_semi").select(edges.columns)


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end in ``nodes(person_id)``."""
    left = edges.join(nodes.withColumnRenamed("person_id", "from_id"), "from_id", "left_anti")
    return left.join(nodes.withColumnRenamed("person_id", "to_id"), "to_id", "left_anti").select(edges.columns)
