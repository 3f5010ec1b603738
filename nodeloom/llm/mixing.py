"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import stored

#: Hex digits of a document's hash that one level of the histogram reads, and the number of levels.
DIGITS, LEVELS = 3, 3
BUCKETS = 16**DIGITS
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes; none gets more than
    ``most`` times its own, and what it leaves goes to the others by weight. The fixpoint of that resharing is a water
    level L with target = min(most * size, L * weight), found by one pass over sources in order of most * size / weight.
    The windows without keys run over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("source_size") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "left": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    by = by.withColumn("level", F.when(F.col("left") / F.col("rest") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("rest")))
    # from the first source that stays below its cap on, later candidates only fall
    by = by.withColumn("level", F.max("level").over(everything))
    full_up = F.col("cap").cast("double")
    target = F.when(F.col("level").isNull(), full_up).otherwise(F.least(full_up, F.col("level") * F.col("weight")))
    return by.select("source", "source_size", target.alias("target"))


def _thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, passes, threshold)``: every document of a source is taken ``passes`` times, and once more if its hash is below the threshold.

    Level by level: sum the sizes of the open range by source and bucket, find the bucket in which the running sum
    passes the budget, and open only that bucket for the next level. At most BUCKETS rows a source are ordered.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # base: where the open bucket begins; taken: what lies below it; whole: no bucket passes the budget
    state = targets.select("source", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("taken"))
    for level in range(LEVELS):
        width = BUCKETS ** (LEVELS - 1 - level)
        inside = docs.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).select("d.source", "size", "h", "passes", "budget", "base", "taken")
        inside = inside.where((F.col("h") >= F.col("base")) & (F.col("h") < F.col("base") + width * BUCKETS))
        bucket = F.floor((F.col("h") - F.col("base")) / width).cast("long")
        sums = inside.groupBy("source", "passes", "budget", "base", "taken", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) + F.col("taken")
        sums = sums.withColumn("upto", upto)
        over = F.col("upto") > F.col("budget")
        bounds = sums.groupBy("source", "passes", "budget").agg(
            F.min(F.when(over, F.struct("bucket", "upto", "n"))).alias("at"), F.max("taken").alias("taken"), F.max("base").alias("base"), F.max("upto").alias("all")
        )
        at = F.col("at")
        # a source of which nothing passes the budget is open to its end and stays so
        bucket = F.coalesce(at["bucket"], F.lit(BUCKETS)).cast("long")
        taken = F.coalesce(at["upto"] - at["n"], F.col("all"))
        if level == LEVELS - 1:  # the last bucket goes in if that comes nearer
            bucket = bucket + F.when(at.isNotNull() & (at["upto"] - F.col("budget") < F.col("budget") - (at["upto"] - at["n"])), 1).otherwise(0)
        state = bounds.select("source", "passes", "budget", (F.col("base") + bucket * width).alias("base"), taken.alias("taken"))
    return state.select("source", "passes", F.col("base").alias("threshold"))


#: Plans with more sources than this are joined by shuffle.
MOST_SENT = 50_000


def _hash() -> Column:
    """36 bits of a hash of id and text, so that rows that share an id, or have none, part by their texts."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, DIGITS * LEVELS), 16, 10).cast("long")


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, target, passes, threshold)`` from ``(source, size, h)``, read several times."""
    targets = stored(source_targets(sized, weights, share, most))
    found = _thresholds(sized, targets)
    return stored(targets.alias("t").join(found.alias("f"), F.expr("t.source <=> f.source"), "left").select("t.*", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("threshold", F.lit(0)).alias("threshold")))


def with_size(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h)``, written once: the texts are read one time."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return stored(documents.select("doc_id", "source", size.alias("size"), _hash().alias("h")))


def with_passes(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows(source, h, ...)`` with ``taken_times``, how often each is taken, and its source's size and target."""
    small = plan.count() <= MOST_SENT
    own = plan.select(F.col("source").alias("own"), "threshold", "passes", "source_size", "target")
    met = rows.join(F.broadcast(own) if small else own, F.col("source").eqNullSafe(F.col("own")))
    times = F.least(F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.lit(most))
    return met.withColumn("taken_times", times).drop("own", "threshold", "passes")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """What a mix takes of every document: ``(doc_id, size, source_size, target, taken)``, a row for each row of ``documents``.

    ``documents`` has doc_id, text and source; other columns are left aside. Size is the number of runs of characters
    outside ASCII white space, 0 for null and empty texts; such documents are taken 0 times. Null is a source of its
    own. A document is taken as a whole, 0 to ``most`` times; the hash of its id and text decides, so reruns agree and
    rows that repeat both share one decision. A source's sum differs from its target by half of the boundary document
    (or of the documents with its 36-bit hash) at most. An empty table gives an empty one.
    """
    sized = with_size(documents)
    met = with_passes(sized, mix_plan(sized, weights, share, most), most)
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_times")).cast("long").alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as mix_sources takes it; documents without a word go. All columns stay, whatever their names."""
    plan = mix_plan(with_size(documents), weights, share, most)
    # the row's own columns travel as one, so that none meets a column of the plan
    rows = documents.where(F.col("text").rlike(WORDS)).select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "source", _hash().alias("h"))
    met = with_passes(rows, plan, most).where("taken_times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("taken_times").cast("int"))))
    return met.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER pre, 0)::DOUBLE AS lef,
             (sum(weight) OVER () - coalesce(sum(weight) OVER pre, 0))::DOUBLE AS rest
      FROM w WINDOW pre AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN lef / rest * weight <= cap THEN lef / rest END) OVER () AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY 1, 2),
c AS (SELECT source, h, n, (sum(n) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM g),
k AS (SELECT c.source, c.h, passes, source_size, target,
             upto <= target - passes * source_size
             OR (upto - n <= target - passes * source_size AND upto - (target - passes * source_size) < (target - passes * source_size) - (upto - n)) AS more
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * least(passes + more::INT, 2)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
