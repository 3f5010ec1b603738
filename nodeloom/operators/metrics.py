"""Evaluation: agreement of labels, reports, ranking metrics and threshold bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import dice
from nodeloom.operators.store import sums_before


def confusion_matrix(rows: DataFrame, true: str = "true_role", predicted: str = "predicted_role") -> DataFrame:
    """``(true_role, predicted_role, n)`` of the pairs that occur."""
    return rows.groupBy(F.col(true).alias("true_role"), F.col(predicted).alias("predicted_role")).agg(F.count("*").alias("n"))


def confusion_pivot(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each true label, one column for each predicted one."""
    return rows.groupBy("true_role").pivot("predicted_role", labels).count().na.fill(0)


def role_report(matrix: DataFrame) -> DataFrame:
    """``(role, precision, recall, f1, support)`` for each label that is true or predicted somewhere; 0 for a division by 0."""
    true = matrix.groupBy(F.col("true_role").alias("role")).agg(F.sum("n").alias("support"))
    called = matrix.groupBy(F.col("predicted_role").alias("role")).agg(F.sum("n").alias("called"))
    hit = matrix.where("true_role = predicted_role").select(F.col("true_role").alias("role"), F.col("n").alias("hit"))
    every = true.join(called, "role", "full").join(hit, "role", "left").na.fill(0, ["support", "called", "hit"])
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hit", "called"), zero), F.coalesce(F.try_divide("hit", "support"), zero)
    return every.select("role", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), "support")


def weighted_f1(report: DataFrame) -> DataFrame:
    """One row ``(weighted_f1)``: f1 weighted by support."""
    return report.agg(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"))


def ari_nmi(matrix: DataFrame) -> DataFrame:
    """One row ``(ari, nmi)``: adjusted Rand index, and mutual information over the mean entropy; 1 where both are trivial."""
    pairs = lambda c: c * (c - 1) / 2
    n = matrix.agg(F.sum("n").alias("total"), F.sum(pairs(F.col("n"))).alias("both"))
    rows = matrix.groupBy("true_role").agg(F.sum("n").alias("a"))
    cols = matrix.groupBy("predicted_role").agg(F.sum("n").alias("b"))
    total = F.broadcast(n.select("total"))
    entropy = lambda df, c: df.join(total).agg(F.sum(pairs(F.col(c))).alias(f"pairs_{c}"), (-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h_{c}"))
    shared = matrix.join(rows, "true_role").join(cols, "predicted_role").join(total)
    mutual = shared.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    one = n.join(entropy(rows, "a")).join(entropy(cols, "b")).join(mutual)
    expected = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), pairs(F.col("total")))
    best = (F.col("pairs_a") + F.col("pairs_b")) / 2
    return one.select(
        F.coalesce(F.try_divide(F.col("both") - expected, best - expected), F.lit(1.0)).alias("ari"),
        F.when((F.col("h_a") == 0) & (F.col("h_b") == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(0.0))).alias("nmi"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score, and those above it."""
    counts = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    return sums_before(counts, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row ``(auc)`` from ``(score, label)``, ties counting half; 0.5 if a class is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") + F.col("pos") / 2.0))
    return _by_score(scored).agg(F.coalesce(F.try_divide(area, F.sum("pos") * F.sum("neg")), F.lit(0.5)).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row ``(ap)``: precision at each distinct score weighted by the recall gained there; 0.5 if a class is missing."""
    tp, fp = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    rows = _by_score(scored).agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return rows.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / F.col("p")).otherwise(0.5).alias("ap"))


def band(value: Column, *bounds: tuple[float, str], otherwise: str) -> Column:
    """The name of the first bound that ``value`` reaches."""
    out = F.lit(otherwise)
    for least, name in reversed(bounds):
        out = F.when(value >= least, name).otherwise(out)
    return out


def stratified_folds(rows: DataFrame, label: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold`` 0..k-1, dealt in turn within each label by hash order."""
    order = Window.partitionBy(label).orderBy(dice(seed, "person_id"), "person_id")
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))
