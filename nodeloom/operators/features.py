"""Behaviour from incidents, the feature table, rule-based roles and importance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import ROLES, by_role, col_or, parse_ids, severity_rank, to_number
from nodeloom.operators.store import percentiles

#: Features that come first in model inputs, and how many others follow in column order.
PRIORITY = ("betweenness", "eigenvector", "degree", "cross_community_edges", "participation_coef", "is_bridge", "clustering_coef", "core_number", "incident_count", "crime_diversity")
OTHERS = 20
LABELS = ("person_id", "node_id", "true_role", "predicted_role")


def behaviour_features(persons: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row for each person: incident_count, crime_diversity, avg_severity and four interaction counts, 0 without incidents.

    Every listed participant counts the incident, and its modus operandi by role, anything else as peripheral. An id
    listed twice counts twice; an unknown severity is an error.
    """
    taken = incidents.select("crime_type", "modus_operandi", severity_rank(F.col("severity")).alias("s"), F.explode(parse_ids(F.col("persons_involved"))).alias("person_id"))
    mode = F.col("modus_operandi")
    named = [F.count_if(mode == r).alias(f"{r.lower()}_interactions") for r in ROLES[:3]]
    peripheral = F.count_if(mode.isNull() | ~mode.isin(*ROLES[:3])).alias("peripheral_interactions")
    sums = taken.groupBy("person_id").agg(F.count("*").alias("incident_count"), F.count_distinct("crime_type").alias("crime_diversity"), F.avg("s").alias("avg_severity"), *named, peripheral)
    every = persons.select("person_id").join(sums, "person_id", "left")
    return every.select("person_id", *[F.coalesce(c, F.lit(0.0 if c == "avg_severity" else 0)).alias(c) for c in sums.columns if c != "person_id"])


def feature_table(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left joins of ``parts`` on person_id; all columns but the key become numbers, 0 where there is none."""
    for part in parts:
        base = base.join(part, "person_id", "left")
    return base.select("person_id", *[to_number(F.col(c)).alias(c) for c in base.columns if c != "person_id"])


def priority_features(df: DataFrame) -> list[str]:
    """Names of the priority features that ``df`` has, then of its first OTHERS other columns."""
    first = [c for c in PRIORITY if c in df.columns]
    rest = [c for c in df.columns if c not in {*first, *LABELS}]
    return first + rest[:OTHERS]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = LABELS) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") and c not in exclude]


def rule_roles(features: DataFrame) -> DataFrame:
    """``(person_id, predicted_role)`` by thresholds, the first rule that holds."""
    v = lambda c: col_or(features, c)
    role = (
        F.when((v("betweenness") > 0.03) & (v("cross_community_edges") > 2) & (v("eigenvector") > 0.05), "Coordinator")
        .when((v("betweenness") > 0.015) & (v("participation_coef") > 0.4) & (v("is_bridge") > 0), "Broker")
        .when((v("degree") > 5) & (v("incident_count") > 10) & (v("crime_diversity") > 2), "Enabler")
        .otherwise("Peripheral")
    )
    return features.select("person_id", role.alias("predicted_role"))


def _clipped(df: DataFrame, low: float, high: float) -> DataFrame:
    """``s`` between its exact percentiles."""
    a, b = percentiles(df, ["s"], [low, high])["s"]
    return df.withColumn("s", F.least(F.greatest("s", F.lit(a)), F.lit(b))) if a is not None else df


def _separated(df: DataFrame, epsilon: float, lifted: Column) -> DataFrame:
    """``s`` of Coordinators replaced by ``lifted`` where their mean is under twice that of Peripherals; both must occur."""
    means = df.agg(F.avg(F.when(F.col("role") == "Coordinator", F.col("s"))).alias("c"), F.avg(F.when(F.col("role") == "Peripheral", F.col("s"))).alias("q"))
    close = F.coalesce(F.try_divide(F.col("c"), F.col("q") + epsilon) < 2, F.lit(False))
    return df.join(F.broadcast(means)).withColumn("s", F.when(close & (F.col("role") == "Coordinator"), lifted).otherwise(F.col("s"))).drop("c", "q")


def _scaled(df: DataFrame, low: Column) -> DataFrame:
    """``s`` brought to 0..1 by its extremes, if they differ."""
    ends = df.agg(low.alias("lo"), F.max("s").alias("hi"))
    spread = F.col("hi") - F.col("lo")
    return df.join(F.broadcast(ends)).withColumn("s", F.when(spread > 0, (F.col("s") - F.col("lo")) / spread).otherwise(F.col("s"))).drop("lo", "hi")


def importance_scores(features: DataFrame, variant: str = "v1", true_role: str = "true_role") -> DataFrame:
    """``(person_id, mo_importance_score)`` from features with a ``predicted_role``; missing columns count as 0.

    v1: the current formula. v0: its predecessor. v2: the repair, which reads ``true_role`` and so leaks labels; it is
    never a default. v3: for supervised roles, with a ``confidence`` column (1 if absent).
    """
    v = lambda c: col_or(features, c)
    role = F.col("predicted_role")
    times = by_role(variant, role) if variant in ("v0", "v1", "v2", "v3") else None
    if variant == "v0":
        base = 0.35 * v("betweenness") + 0.25 * v("eigenvector") + 0.15 * (0.1 * v("is_bridge")) + 0.15 * v("cross_community_edges") / 10 + 0.10 * v("incident_count") / 100
        df = features.select("person_id", role.alias("role"), (base * times).alias("s"))
        return _over_max(df)
    if variant == "v1":
        base = 0.40 * v("betweenness") + 0.25 * v("eigenvector") + 0.15 * v("degree") / 50 + 0.10 * (0.2 * v("is_bridge")) + 0.05 * v("cross_community_edges") / 10 + 0.05 * v("core_number") / 10
        raised = base * (1 + 0.2 * times) * times
        df = features.select("person_id", role.alias("role"), F.when((role == "Coordinator") & (v("degree") > 20), raised * 1.3).otherwise(raised).alias("s"))
        df = _scaled(_separated(_clipped(df, 0.05, 0.95), 1e-6, F.col("s") * 2), F.min("s"))
        return df.select("person_id", F.col("s").alias("mo_importance_score"))
    if variant == "v2":
        own = F.col(true_role)
        structure = 0.35 * v("betweenness") + 0.25 * v("eigenvector") + 0.15 * v("degree") / 50 + 0.10 * v("core_number") / 10 + 0.10 * v("cross_community_edges") / 10 + 0.05 * v("is_bridge")
        behaviour = 0.40 * v("incident_count") / 100 + 0.30 * v("coordinator_interactions") / 10 + 0.30 * v("crime_diversity") / 10
        both = 0.7 * by_role("v2", own) + 0.3 * times
        raised = (0.7 * structure + 0.3 * behaviour) * both
        df = features.select("person_id", own.alias("role"), F.when((own == "Coordinator") & (v("degree") > 15), raised * 1.4).otherwise(raised).alias("s"))
        df = _separated(_scaled(_clipped(df, 0.02, 0.98), F.min("s")), 0.0, F.least(F.col("s") * 1.5, F.lit(1.0)))
        return df.select("person_id", F.col("s").alias("mo_importance_score"))
    if variant == "v3":
        sure = col_or(features, "confidence", 1.0)
        df = features.select("person_id", role.alias("role"), ((0.6 * v("betweenness") + 0.4 * v("eigenvector")) * times * sure).alias("s"))
        return _over_max(df)
    raise ValueError(f"unknown variant {variant!r}")


def _over_max(df: DataFrame) -> DataFrame:
    return _scaled(df, F.lit(0.0)).select("person_id", F.col("s").alias("mo_importance_score"))


def top_targets(scores: DataFrame, persons: DataFrame, k: int) -> DataFrame:
    """``(rank, person_id, role, mo_importance_score)`` of the ``k`` highest, ties to the smaller id."""
    best = scores.join(persons.select("person_id", "role"), "person_id").orderBy(F.desc("mo_importance_score"), "person_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("mo_importance_score"), "person_id"))
    return best.select(rank.alias("rank"), "person_id", "role", "mo_importance_score")


def role_mix(targets: DataFrame, persons: DataFrame) -> DataFrame:
    """``(role, selected, total, coverage)``: how many of each role are among ``targets``."""
    total = persons.groupBy("role").agg(F.count("*").alias("total"))
    chosen = targets.groupBy("role").agg(F.count("*").alias("selected"))
    return total.join(chosen, "role", "left").select("role", F.coalesce("selected", F.lit(0)).alias("selected"), "total", (F.coalesce("selected", F.lit(0)) / F.col("total")).alias("coverage"))


def role_distribution(persons: DataFrame) -> DataFrame:
    """``(role, count, share)``, share in percent."""
    counts = persons.groupBy("role").agg(F.count("*").alias("count"))
    return counts.withColumn("share", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def stats_by_role(rows: DataFrame, column: str) -> DataFrame:
    """``(role, n, mean, std, median, low, high)`` of ``column``, std of the sample."""
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.expr(f"percentile({column}, 0.5)").alias("median"), F.min(column).alias("low"), F.max(column).alias("high"))


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as (x - median) / (p75 - p25) from exact percentiles, a spread of 0 counting as 1; other columns stay."""
    quartiles = percentiles(df, columns, [0.25, 0.5, 0.75])

    def scaled(c: str) -> Column:
        low, middle, high = quartiles[c]
        return ((F.col(c) - F.lit(middle)) / F.lit(1.0 if high == low else high - low)).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])
