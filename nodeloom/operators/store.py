"""Cut lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='nodeloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, without lineage, kept if executors are lost."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def released(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` returned and that nothing reads any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sums_before(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with each column of ``sums`` added up over the rows that come before in ``order``, without a task that sees all rows.

    Rows are dealt into ranges, written once, and added up in each; one row a range is added up over the ranges.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftrightunsigned(F.col("__at"), 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = parts.select("__part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(before), "__part")
    return met.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__at", "__part", *[f"__{n}" for n in sums])


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: how many rows come before in ``order``."""
    return sums_before(df, list(order), {name: F.lit(1).cast("long")})


def percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact percentiles of numeric columns, with linear interpolation between neighbours; nulls are left out, None without values.

    All columns' values are sorted together as rows (column, value); a few rows come back for each column.
    """
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]))
    rows = stored(ranked(df.select(every.alias("x")).select("x.*").where("v IS NOT NULL"), "c", "v", name="r"))
    counts = {r["c"]: (r["low"], r["n"]) for r in rows.groupBy("c").agg(F.min("r").alias("low"), F.count("*").alias("n")).collect()}
    asked = {i: [(low + int(p * (n - 1)), low + min(int(p * (n - 1)) + 1, n - 1), p * (n - 1) - int(p * (n - 1))) for p in shares] for i, (low, n) in counts.items()}
    places = sorted({x for spots in asked.values() for a, b, _ in spots for x in (a, b)})
    at = {r["r"]: r["v"] for r in rows.where(F.col("r").isin(places)).collect()} if places else {}
    released(rows)
    return {c: [at[a] + (at[b] - at[a]) * f for a, b, f in asked[i]] if i in asked else [None] * len(shares) for i, c in enumerate(columns)}


#: Rows of a key from which on it may be a hot one.
LEAST_HOT = 256


def joined_to_keys(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``keyed``, one row for each key, which says in ``n`` how many of the ``total`` rows have it.

    Hot keys, with more than LEAST_HOT rows and more than an eighth of an even partition's, go to the rows: at most eight
    times as many as partitions. The others meet by shuffle.
    """
    bound = max(LEAST_HOT, total // (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = keyed.where(F.col(n) > bound)
    sent = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(n) <= bound), key, "left")
    return sent.unionByName(rest)
