"""A network over order tables: parts are persons, parts returned in one order are related, orders are incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.graph import Network


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_of(size: Column) -> Column:
    """Roles in shares of 8, 14, 20 and 58 % of sizes 1 to 50."""
    return F.when(size <= 4, "Coordinator").when(size <= 11, "Broker").when(size <= 21, "Enabler").otherwise("Peripheral")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), role_of(F.col("p_size")).alias("role"), F.col("p_type").alias("community"), (25 + F.col("p_partkey") % 40).cast("int").alias("age"))


def relation_type(a: Column, b: Column) -> Column:
    return F.when((a == "Coordinator") | (b == "Coordinator"), "hierarchical").when((a == "Broker") | (b == "Broker"), "coordination").otherwise("operational")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts by the orders that hold both as returned; both sides of the self-join are dealt by order."""
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    pairs = lines.alias("a").join(lines.alias("b"), F.expr("a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"))
    counted = pairs.groupBy(F.col("a.l_partkey").alias("from_id"), F.col("b.l_partkey").alias("to_id")).agg(F.count("*").alias("weight"))
    role = persons(spark, sf_dir).select("person_id", "role")
    ends = counted.join(role.toDF("from_id", "ra"), "from_id").join(role.toDF("to_id", "rb"), "to_id")
    return ends.select("from_id", "to_id", "weight", relation_type(F.col("ra"), F.col("rb")).alias("relation_type"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    who = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("person_id"), F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ";").alias("persons_involved"))
    role = persons(spark, sf_dir).select("person_id", F.col("role").alias("modus_operandi"))
    orders = _table(spark, sf_dir, "orders")
    severity = F.when(F.col("o_totalprice") > 400000, "Severe").when(F.col("o_orderstatus") == "P", "High").when(F.col("o_orderstatus") == "O", "Medium").otherwise("Low")
    return orders.join(who, orders["o_orderkey"] == who["l_orderkey"]).join(role, "person_id").select(
        F.col("o_orderkey").alias("incident_id"), "person_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("crime_type"), "modus_operandi",
        severity.alias("severity"), F.concat(F.lit("City_"), (F.col("o_custkey") % 10 + 1).cast("string")).alias("location"), "persons_involved",
    )


def network(spark: SparkSession, sf_dir: str) -> Network:
    return Network(persons(spark, sf_dir), relations(spark, sf_dir), incidents(spark, sf_dir))
