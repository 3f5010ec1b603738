"""What the operators of this subpackage share: table access, cut lineage, batch maps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``; a temporary one only where all run on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='nodeloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It is computed once, its lineage ends at the files, and they outlive any executor.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def released(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` returned and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a key from which on it may be a hot one.
LEAST_HOT = 256


def joined_to_keys(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, how: str = "left", alike: bool = False) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and says in ``n`` how many of the ``total`` rows have it.

    Rows of a hot key would all meet in one task. Hot keys have more than LEAST_HOT rows and more than an eighth of an
    even partition's, so there are at most eight times as many as partitions; they go to the rows, the others by
    shuffle, with ``alike`` also where ``keyed`` is small enough to be sent, so that the plan is the same at every size.
    Null keys are left out of the join. ``keyed`` is read three times and ``rows`` as often.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = max(LEAST_HOT, total // (8 * parts))
    hot = keyed.where(F.col(n) > bound)
    known = rows.where(F.col(key).isNotNull())
    sent = known.join(F.broadcast(hot), key, "inner")
    others = keyed.where(F.col(n) <= bound)
    rest = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(others.hint("merge") if alike else others, key, how)
    out = sent.unionByName(rest.select(sent.columns))
    if how == "left":
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema.fields if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *extra).select(sent.columns))
    return out


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and the next stage's need adds to what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows that are Python objects at a time. Spark's batches hold up to twenty times as many texts.
ROWS_AT_ONCE = 500


def arrow_map(df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]) -> DataFrame:
    """Maps Arrow batches, in slices; ``make`` runs once for each task and returns the function that maps a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield from each(batch.slice(start, ROWS_AT_ONCE))
        each = batch = None
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty one."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes sum to ``most`` at most, or single rows."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n vertices' component under the edges a-b."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` for every vertex of an edge, root the smallest vertex.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is one aggregation by vertex, and a
    vertex with many edges goes to them rather than they to it. The edges are written between rounds, so no lineage
    builds up; a round's tables go when the next one's are there. An empty table gives an empty one.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    many = now.count()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = joined_to_keys(both.where("v > u"), low, "u", "n", 2 * many, "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the rows of low keep each vertex tied to its own smallest neighbour
        large = stored(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        near = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = joined_to_keys(large, near, "u", "n", 2 * many, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct())
        more = after.count()
        same = more == many and after.join(now, ["u", "v"], "left_anti").isEmpty()
        for old in (now, low, large, near):
            released(old)
        now, many = after, more
        if same:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")
