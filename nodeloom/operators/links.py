"""Link prediction: splits, sampled non-edges, pair scores, enclosing subgraphs, a classifier and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import dice
from nodeloom.operators import csr
from nodeloom.operators.graph import adjacency, degrees
from nodeloom.operators.iterative import bfs
from nodeloom.operators.store import stored

SCORES = ("common_neighbours", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment")


def split_sizes(m: int, most: int | None = None) -> dict[str, int]:
    """Edges in test, val and train: a fifth (a third at most), half of that, and the rest up to ``most``."""
    test = min(int(0.2 * m), m // 3)
    val = test // 2
    return {"test": test, "val": val, "train": min(m - test - val, most if most is not None else m)}


def edge_split(edges: DataFrame, seed: int = 42, most: int | None = None) -> DataFrame:
    """``(from_id, to_id, split)`` in hash order: test first, then val, then train; edges beyond the cap go."""
    sizes = split_sizes(edges.count(), most)
    mixed = edges.select("from_id", "to_id", dice(seed, "from_id", "to_id").alias("m"))
    # zipped ranks would need one task for all edges; the hash's prefix deals them into ordered buckets instead
    bucket = F.conv(F.substring("m", 1, 3), 16, 10).cast("int")
    mixed = mixed.withColumn("bucket", bucket)
    before = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("m", "from_id", "to_id"))
    ranked = mixed.join(F.broadcast(before.select("bucket", "before")), "bucket").withColumn("r", place)
    a, b = sizes["test"], sizes["test"] + sizes["val"]
    split = F.when(F.col("r") <= a, "test").when(F.col("r") <= b, "val").when(F.col("r") <= b + sizes["train"], "train")
    return ranked.withColumn("split", split).where("split IS NOT NULL").select("from_id", "to_id", "split")


def negative_samples(vertices: DataFrame, edges: DataFrame, positives: DataFrame, seed: int = 42, tries: int = 8) -> DataFrame:
    """``(from_id, to_id, split)``: for each positive one pair of its smaller end that is no edge, the first of ``tries`` hash-chosen ends.

    Ends are drawn from the sorted ids by number, so nothing is crossed. Where all tries fail, the end is drawn among
    the persons that the smaller end is not joined to; if there are none, a hash-chosen person that has some takes its
    place, and in a complete graph the pair is any one. Joins with a row for each edge or person are merges: packed files
    of them look small enough to be sent, and the driver would build their tables.
    """
    # ids to numbers, by buckets of the id's hash rather than in one task
    numbered = _numbered(vertices)
    n = vertices.count()
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "from_id", "to_id", F.col("t").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = positives.select("from_id", "to_id", "split", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("t")).withColumn("number", pick % F.lit(max(1, n)))
    pairs = drawn.join(numbered.hint("merge"), "number").where("person_id <> from_id").select("from_id", "to_id", "split", "t", F.least("from_id", "person_id").alias("u"), F.greatest("from_id", "person_id").alias("v"))
    free = pairs.join(edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).hint("merge"), ["u", "v"], "left_anti")
    first = stored(free.groupBy("from_id", "to_id", "split").agg(F.min(F.struct("t", "u", "v")).alias("x")).select("from_id", "to_id", "split", "x.u", "x.v"))
    left = positives.select("from_id", "to_id", "split").distinct().join(first.hint("merge"), ["from_id", "to_id", "split"], "left_anti")
    left = stored(left.withColumn("t", F.lit(tries + 1)).withColumn("r", pick).withColumn("t", F.lit(tries + 2)).withColumn("q", pick).drop("t"))
    out = first.select(F.col("u").alias("from_id"), F.col("v").alias("to_id"), "split")
    return out if n < 2 or left.isEmpty() else out.unionByName(_free_pairs(vertices, edges, stored(numbered), n, left))


def _free_pairs(vertices: DataFrame, edges: DataFrame, numbered: DataFrame, n: int, left: DataFrame) -> DataFrame:
    """``(from_id, to_id, split)``: a pair for each row of ``left(from_id, to_id, split, r, q)``, r and q being its random numbers.

    Of the f persons that an end is not joined to, the one of place r modulo f is taken. Its number is that place plus
    the joined ones before it, which one sort of an end's neighbours and rows counts for all of its rows.
    """
    near = adjacency(edges).select(F.col("src").alias("base"), F.col("dst").alias("person_id")).unionByName(vertices.select(F.col("person_id").alias("base"), "person_id")).distinct()
    taken = stored(near.join(numbered, "person_id").select("base", "number"))
    counts = taken.groupBy("base").agg(F.count("*").alias("taken"))
    some = stored(_numbered(vertices.join(counts.where(F.col("taken") < n).withColumnRenamed("base", "person_id"), "person_id", "left_semi")))
    m = some.count()
    own = left.join(counts.withColumnRenamed("base", "from_id"), "from_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    full = own.where(F.col("taken") >= n).drop("taken")
    asked = own.where(F.col("taken") < n).select("from_id", "to_id", "split", "r", F.col("from_id").alias("base"), "taken")
    if m:
        moved = full.withColumn("number", F.col("q") % m).join(some, "number").withColumnRenamed("person_id", "base").join(counts, "base")
        asked = asked.unionByName(moved.select("from_id", "to_id", "split", "r", "base", "taken"))
    asked = stored(asked.select("base", (F.col("r") % (n - F.col("taken"))).alias("place"), F.lit(1).alias("ask"), "split"))
    before = F.row_number().over(Window.partitionBy("base").orderBy("number")) - 1
    joined = taken.join(asked, "base", "left_semi").select("base", (F.col("number") - before).alias("place"), F.lit(0).alias("ask"), F.lit(None).cast("string").alias("split"))
    passed = F.sum(1 - F.col("ask")).over(Window.partitionBy("base").orderBy("place", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = joined.unionByName(asked).withColumn("number", F.col("place") + passed).where("ask = 1").join(numbered, "number").select("base", "person_id", "split")
    if not m:
        # r and q give two different numbers
        a, b = F.col("r") % n, F.col("q") % (n - 1)
        two = full.select("split", a.alias("number"), (b + (b >= a).cast("int")).alias("other")).join(numbered, "number").withColumnRenamed("person_id", "base").drop("number")
        found = found.unionByName(two.withColumnRenamed("other", "number").join(numbered, "number").select("base", "person_id", "split"))
    return found.select(F.least("base", "person_id").alias("from_id"), F.greatest("base", "person_id").alias("to_id"), "split")


def _numbered(vertices: DataFrame) -> DataFrame:
    """``(number, person_id)``: 0.. in order of the ids' hashes."""
    mixed = vertices.select("person_id", F.md5(F.col("person_id").cast("string")).alias("m")).withColumn("bucket", F.substring("m", 1, 3))
    before = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("m", "person_id")) - 1
    return mixed.join(F.broadcast(before.select("bucket", "before")), "bucket").select(place.alias("number"), "person_id")


def link_scores(vertices: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(from_id, to_id, ...)`` with common_neighbours, jaccard, adamic_adar, resource_allocation, preferential_attachment.

    The pair itself is no neighbour of itself, so an edge's own presence adds to the degrees only.
    """
    adj = adjacency(edges)
    degree = degrees(vertices, edges)
    asked = pairs.select("from_id", "to_id").distinct()
    one = asked.join(adj.select(F.col("src").alias("from_id"), F.col("dst").alias("z")), "from_id")
    both = one.join(adj.select(F.col("src").alias("to_id"), F.col("dst").alias("z")), ["to_id", "z"])
    weights = both.join(degree.select(F.col("person_id").alias("z"), F.col("degree").alias("dz")), "z")
    sums = weights.groupBy("from_id", "to_id").agg(F.count("*").alias("cn"), F.sum(F.try_divide(F.lit(1.0), F.log("dz"))).alias("aa"), F.sum(1.0 / F.col("dz")).alias("ra"))
    d = pairs.join(degree.select(F.col("person_id").alias("from_id"), F.col("degree").alias("du")), "from_id").join(degree.select(F.col("person_id").alias("to_id"), F.col("degree").alias("dv")), "to_id")
    d = d.join(sums, ["from_id", "to_id"], "left")
    cn = F.coalesce("cn", F.lit(0))
    return d.select(
        *pairs.columns, cn.alias("common_neighbours"), F.coalesce(F.try_divide(cn, F.col("du") + F.col("dv") - cn), F.lit(0.0)).alias("jaccard"),
        F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"), F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"), (F.col("du") * F.col("dv")).alias("preferential_attachment"),
    )


def candidates(edges: DataFrame) -> DataFrame:
    """Pairs two hops apart that are no edge. Wedges are listed by their middle node."""
    adj = adjacency(edges)
    two = adj.alias("a").join(adj.alias("b"), F.expr("a.dst = b.src AND a.src < b.dst")).select(F.col("a.src").alias("from_id"), F.col("b.dst").alias("to_id")).distinct()
    return two.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def augmented(edges: DataFrame, predicted: DataFrame | None = None, k: int = 0, score: str = "adamic_adar") -> DataFrame:
    """Edges of kind ``original``, and the ``k`` best of ``predicted`` as edges of weight 1 and kind ``predicted``.

    Without predictions it is the copy of the graph that an augmentation without links is.
    """
    out = edges.select("from_id", "to_id", F.col("weight").cast("long").alias("weight"), F.lit("original").alias("relation_type"))
    if predicted is None or k <= 0:
        return out
    best = predicted.orderBy(F.desc(score), "from_id", "to_id").limit(k)
    return out.unionByName(best.select("from_id", "to_id", F.lit(1).cast("long").alias("weight"), F.lit("predicted").alias("relation_type")))


def enclosing_subgraphs(edges: DataFrame, pairs: DataFrame, hops: int = 2, drop_target: bool = False) -> DataFrame:
    """``(from_id, to_id, nodes, edges, n_nodes, n_edges, edge_index)`` for each pair.

    nodes: the union of both ends' balls of ``hops``, sorted. edges: the induced ones as (i, j) of sorted positions;
    edge_index has both directions, or the loop (0, 0) without edges. The target pair stays in unless ``drop_target``.
    """
    ends = pairs.select(F.explode(F.array("from_id", "to_id")).alias("person_id")).distinct()
    balls = stored(bfs(edges, ends, hops).select("src", "node"))
    one = pairs.select("from_id", "to_id").distinct()
    members = one.join(balls.withColumnRenamed("src", "from_id"), "from_id").unionByName(one.join(balls.withColumnRenamed("src", "to_id"), "to_id")).distinct()
    place = F.row_number().over(Window.partitionBy("from_id", "to_id").orderBy("node")) - 1
    placed = stored(members.select("from_id", "to_id", "node", place.alias("i")))
    e = edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y"))
    inside = placed.withColumnRenamed("node", "x").join(e, "x").join(placed.select("from_id", "to_id", F.col("node").alias("y"), F.col("i").alias("j")), ["from_id", "to_id", "y"])
    if drop_target:
        inside = inside.where(~((F.col("x") == F.col("from_id")) & (F.col("y") == F.col("to_id"))))
    grouped = inside.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("edges"))
    nodes = placed.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    both = nodes.join(grouped, ["from_id", "to_id"], "left")
    known = F.coalesce("edges", F.array().cast("array<struct<i:int,j:int>>"))
    turned = F.transform(known, lambda s: F.struct(s["j"].alias("i"), s["i"].alias("j")))
    loop = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return both.select("from_id", "to_id", "nodes", known.alias("edges"), F.size("nodes").alias("n_nodes"), F.size(known).alias("n_edges"), F.when(F.size(known) > 0, F.concat(known, turned)).otherwise(loop).alias("edge_index"))


def enclosing_sizes(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, hops: int = 2) -> DataFrame:
    """``(from_id, to_id, n_nodes, n_edges)`` of enclosing_subgraphs; a graph within csr's bounds is held whole by each task, beyond, balls are rows."""
    graph = csr.compact(vertices, edges)
    if graph is not None:
        return csr.enclosing_sizes(graph, pairs, hops)
    return enclosing_subgraphs(edges, pairs, hops).select("from_id", "to_id", "n_nodes", "n_edges")


def wedge_counts(edges: DataFrame) -> DataFrame:
    """``(from_id, to_id, common_neighbours)`` of the candidates: a pair's wedges are its common neighbours, so one listing counts them."""
    adj = adjacency(edges)
    two = adj.alias("a").join(adj.alias("b"), F.expr("a.dst = b.src AND a.src < b.dst")).groupBy(F.col("a.src").alias("from_id"), F.col("b.dst").alias("to_id")).agg(F.count("*").alias("common_neighbours"))
    return two.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def node_inputs(vertices: DataFrame, edges: DataFrame, features: DataFrame | None, dim: int) -> DataFrame:
    """``(person_id, x)``: the feature vector as floats cut or padded with 0 to ``dim``, else (degree, degree / (highest + 1e-6), 0...)."""
    if features is not None:
        names = [c for c, kind in features.dtypes if kind in ("int", "bigint", "float", "double") and c not in ("person_id", "node_id")][:dim]
        values = [F.col(f"`{c}`").cast("float") for c in names]
        base = features.select("person_id", F.array(*values).alias("x"))
    else:
        d = degrees(vertices, edges)
        base = d.join(F.broadcast(d.agg(F.max("degree").alias("top")))).select("person_id", F.array(F.col("degree").cast("float"), (F.col("degree") / (F.col("top") + 1e-6)).cast("float")).alias("x"))
    return base.select("person_id", F.slice(F.concat("x", F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim).alias("x"))


def subgraph_inputs(edges: DataFrame, pairs: DataFrame, inputs: DataFrame, hops: int = 2) -> DataFrame:
    """``pairs(from_id, to_id, ...)`` with ``x``, the inputs ``(person_id, x)`` of the subgraph's nodes in order, and ``edge_index``; the target pair is no edge of it."""
    sub = stored(enclosing_subgraphs(edges, pairs.select("from_id", "to_id"), hops, drop_target=True).select("from_id", "to_id", "nodes", "edge_index"))
    x = sub.select("from_id", "to_id", F.posexplode("nodes").alias("i", "person_id")).join(inputs, "person_id").groupBy("from_id", "to_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x"))
    both = sub.select("from_id", "to_id", "edge_index").join(x.withColumn("x", F.transform("x", lambda s: s["x"])), ["from_id", "to_id"])
    return pairs.join(both, ["from_id", "to_id"])


def train_classifier(samples: DataFrame, columns: tuple[str, ...] = SCORES, rounds: int = 50):
    """A logistic model of ``label`` over pair scores, standardised; ``samples`` has the columns, ``label`` and ``split``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", maxIter=rounds, regParam=1e-3)]
    return Pipeline(stages=stages).fit(samples.where("split = 'train'").withColumn("label", F.col("label").cast("double")))


def classified(model, samples: DataFrame) -> DataFrame:
    """``samples`` with ``score``, the probability of a link."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(samples.withColumn("label", F.col("label").cast("double")))
    return out.select(*samples.columns, vector_to_array("probability")[1].alias("score"))
