"""Base tables in files: schemas, scans, sinks, phase stores and shards."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.graph import Network, canonical_edges
from nodeloom.operators.store import ranked

SCHEMAS = {
    "persons": "person_id bigint, name string, role string, community int, age int",
    "relations": "from_id bigint, to_id bigint, weight int, relation_type string",
    "incidents": "incident_id bigint, person_id bigint, date string, crime_type string, modus_operandi string, severity string, location string, persons_involved string, description string",
}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; with a schema its columns, without one inferred types."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    return read_csv(spark, path, schema) if exists(spark, path) else None


def read_network(spark: SparkSession, folder: str, relations: str = "relations.csv") -> Network:
    """The network in ``folder``: persons.csv, a relations file and, if there, incidents.csv. Vertices are all persons."""
    edges = canonical_edges(read_csv(spark, f"{folder}/{relations}", SCHEMAS["relations"]).withColumn("seq", F.monotonically_increasing_id()), "seq")
    return Network(read_csv(spark, f"{folder}/persons.csv", SCHEMAS["persons"]), edges, read_optional(spark, f"{folder}/incidents.csv", SCHEMAS["incidents"]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """Rows as one JSON object a line."""
    report.write.mode("overwrite").json(path)


class PhaseStore:
    """Phases' tables as Parquet under a hash of the settings, so that a change of settings never meets stale tables."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark = spark
        self.root = f"{folder}/{hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]}"

    def path(self, phase: str, name: str) -> str:
        return f"{self.root}/{phase}/{name}"

    def done(self, phase: str, names: list[str]) -> bool:
        """Whether all of a phase's tables are complete."""
        return all(exists(self.spark, f"{self.path(phase, n)}/_SUCCESS") for n in names)

    def save(self, phase: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(phase, name))
        return self.load(phase, list(tables))

    def load(self, phase: str, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(self.path(phase, n)) for n in names}

    def once(self, phase: str, names: list[str], make, force: bool = False) -> dict[str, DataFrame]:
        """The phase's tables, computed only if they are incomplete or ``force`` is set."""
        return self.load(phase, names) if not force and self.done(phase, names) else self.save(phase, make())


def shards(edges: DataFrame, parts: int = 3) -> DataFrame:
    """``edges`` with ``shard``: contiguous parts in order of the pair, of m // parts rows, the last with the rest."""
    m = edges.count()
    return ranked(edges, "from_id", "to_id", name="row").withColumn("shard", F.least((F.col("row") / max(1, m // parts)).cast("int"), F.lit(parts - 1))).drop("row")


def fingerprint(edges: DataFrame) -> str:
    """A name of the edge set: order and repeats of reading do not change it."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("from_id", "to_id")).alias("x"), F.sum(F.pmod(F.xxhash64("to_id", "from_id"), F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['x']}:{row['s']}".encode()).hexdigest()[:16]


def cached_subgraphs(spark: SparkSession, folder: str, edges: DataFrame, name: str, make, force: bool = False) -> DataFrame:
    """The subgraphs ``name`` of the graph ``edges``, as Parquet under its fingerprint: another graph never meets them."""
    at = f"{folder}/{fingerprint(edges)}/{name}"
    if force or not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows and, for arrays, their lengths: a look into a stored table."""
    sizes = [F.size(c).alias(f"{c}_size") for c, kind in df.dtypes if kind.startswith("array")]
    return df.limit(rows).select("*", *sizes)


def save_model(model, path: str) -> None:
    """A Spark ML pipeline model or a forest, in its own format."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    from nodeloom.operators import forest

    return forest.loaded(SparkSession.active(), path) or PipelineModel.load(path)


def save_weights(spark: SparkSession, parameters: list, path: str) -> None:
    """Arrays of numbers as Parquet."""
    rows = [(i, list(p.shape), [float(x) for x in p.ravel()]) for i, p in enumerate(parameters)]
    spark.createDataFrame(rows, "i int, shape array<int>, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> list:
    import numpy as np

    return [np.array(r["v"]).reshape(r["shape"]) for r in spark.read.parquet(path).orderBy("i").collect()]


def save_training(spark: SparkSession, net, epoch: int, auc: float, path: str) -> None:
    """A training state: epoch, AUC, the net's weights and the optimizer's moments and step."""
    for name, values in (("weights", net.p), ("first", net.m), ("second", net.v)):
        save_weights(spark, values, f"{path}/{name}")
    spark.createDataFrame([(epoch, float(auc), net.t)], "epoch int, auc double, step int").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_training(spark: SparkSession, net, path: str) -> tuple[int, float]:
    """Puts a saved state into ``net``; gives its epoch and AUC."""
    net.p, net.m, net.v = (load_weights(spark, f"{path}/{name}") for name in ("weights", "first", "second"))
    row = spark.read.parquet(f"{path}/state").first()
    net.t = row["step"]
    return row["epoch"], row["auc"]
