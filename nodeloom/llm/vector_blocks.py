"""Vectors in blocks by their nearest pivot, and the meeting of query groups with the blocks that their bounds leave open."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import arrow_map, joined_to_keys, released, stored

#: Vectors in a block and queries in a group, on average.
BLOCK, GROUP = 4096, 512
#: Queries that meet a block at a time, on average.
ASKED = 2048
#: Pivots of a dimension at most, and blocks whose balls are sent to the tasks at a time.
MOST_PIVOTS, MOST_SENT = 256, 20_000
#: Blocks whose numbers, 12 bytes each, are sent to the tasks.
MOST_NUMBERS = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What a search does with a block.

    ``index(data)`` makes a block's index, as bytes. ``space(data)`` are the vectors as the bounds see them.
    ``find(ids, data, index, query_ids, queries, bounds, k)`` gives (query_id, vec_id, score) of a block's best for each
    query, k of them or those that its bound, the k-th score so far or NaN, does not rule out; it leaves out the query's
    own rows. ``open(distance, product, norms, radius, most, bounds)`` tells which queries a block may still serve, from
    the queries' distances to and products with its centre.
    """

    index: Callable
    space: Callable
    find: Callable
    open: Callable
    score: str
    descending: bool


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, dim)`` of the rows whose vector is not null, nor holds a null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("dim"))


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension some vectors, chosen by hash: one for each block, MOST_PIVOTS at most. About four times as many rows are gathered."""
    n = rows.count()
    mixed = rows.withColumn("h", F.xxhash64("v", "vec_id"))
    share = min(1.0, 4 * MOST_PIVOTS / max(1, n))
    sample = mixed.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < share).orderBy("h").limit(8 * MOST_PIVOTS).select("dim", "v", "h").collect()
    out: dict[int, list] = {}
    for r in sample:
        out.setdefault(r["dim"], []).append(r["v"])
    most = min(MOST_PIVOTS, -(-n // BLOCK))
    return {dim: np.unique(np.array(vs[:most], np.float64), axis=0) for dim, vs in out.items()}


def assigned(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(vec_id, v, dim, cell)``, written once: a cell is the vectors of one dimension that one pivot is nearest to."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # 8 * MOST_PIVOTS vectors at most

    def make():
        def each(batch: pa.RecordBatch):
            dims, lists = batch.column(2).to_numpy(), batch.column(1)
            values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            near = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                own = held.value.get(int(dim))
                if own is not None and dim > 0 and len(own) > 1:
                    at = np.flatnonzero(dims == dim)
                    x = values[starts[at][:, None] + np.arange(dim)]
                    near[at] = ((own**2).sum(1)[None, :] - 2 * x @ own.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int64) * MOST_PIVOTS + near)], names=[*batch.schema.names, "cell"])

        return each

    return stored(arrow_map(rows.select("vec_id", "v", "dim"), "vec_id long, v array<double>, dim int, cell long", make))


def packed(rows: DataFrame, size: int, name: str, total: int) -> DataFrame:
    """Blocks of about ``size`` rows of a cell: ``(dim, cell, name, ids, data, bounds)``, ids as int64, the others as float64.

    ``rows(vec_id, v, dim, cell, bound)``. A cell's rows are dealt by the hash of their id and vector, so that a cell of
    any size, also of copies, spreads. A block's rows are gathered in one task: a few thousand by construction.
    """
    counts = stored(rows.groupBy("cell").agg(F.count("*").alias("n")))
    dealt = joined_to_keys(rows, counts, "cell", "n", total, "inner").withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / size)).cast("int"))

    def pack(batch: pa.Table) -> pa.Table:
        ids = batch["vec_id"].to_numpy().astype(np.int64)
        data = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in batch["v"].chunks]) if len(ids) else np.zeros(0)
        order = np.argsort(ids, kind="stable")
        data = data.reshape(len(ids), -1)[order]
        bounds = batch["bound"].to_numpy().astype(np.float64)[order]
        return pa.table({"dim": batch["dim"].slice(0, 1), "cell": batch["cell"].slice(0, 1), name: batch["b"].slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary()), "bounds": pa.array([bounds.tobytes()], pa.binary())})

    return dealt.select("vec_id", "v", "dim", "cell", "b", "bound").groupBy("cell", "b").applyInArrow(pack, f"dim int, cell long, {name} int, ids binary, data binary, bounds binary")


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(data, np.float64).reshape(len(found), dim)


def first_of_each(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, ids, scores) of the ``k`` rows of each q that come first by ``order``, ties to the smaller id."""
    by = np.lexsort((ids, order, q))
    q = q[by]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], ids[by][kept], scores[by][kept]


def _indexed(blocks: DataFrame, kind: Kind) -> DataFrame:
    """Blocks with their index and their ball: centre, radius and the largest squared norm."""

    def build():
        def each(batch: pa.RecordBatch):
            rows = []
            for row in batch.to_pylist():
                _, data = unpack(row["ids"], row["data"], row["dim"])
                x = kind.space(data)
                centre = x.mean(0)
                rows.append(row | {"index": kind.index(data), "centre": centre.tobytes(), "radius": float(np.sqrt(((x - centre) ** 2).sum(1)).max()), "most": float((x**2).sum(1).max())})
            if rows:
                names = ["dim", "cell", "block", "ids", "data", "index", "centre", "radius", "most"]
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

        return each

    return stored(arrow_map(blocks, "dim int, cell long, block int, ids binary, data binary, index binary, centre binary, radius double, most double", build))


class Bounds:
    """The k-th score so far of every query that a task has met, over all of its blocks."""

    def __init__(self, kind: Kind, k: int):
        self.sign, self.k, self.best = 1.0 if kind.descending else -1.0, k, {}

    def of(self, query_ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``bounds`` or the k-th score that is known here, if that is nearer; NaN: none."""
        none = np.array([-np.inf])
        known = np.array([self.best.get(q, none)[0] for q in query_ids.tolist()])
        out = np.fmax(self.sign * bounds, known)
        return self.sign * np.where(np.isneginf(out), np.nan, out)

    def add(self, q: np.ndarray, scores: np.ndarray) -> None:
        q, scores = np.asarray(q, np.int64), np.asarray(scores, np.float64)
        order = np.argsort(q, kind="stable")
        q, scores = q[order], self.sign * scores[order]
        cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        for i, own in zip(q[cuts].tolist(), np.split(scores, cuts[1:]), strict=False):
            known = self.best.get(i)
            if known is None:
                known = np.full(self.k, -np.inf)
            self.best[i] = np.sort(np.concatenate([known, own]))[-self.k :]  # worst first


def _met(pairs: DataFrame, kind: Kind, k: int) -> DataFrame:
    """``(query_id, vec_id, score)`` of the meetings ``(dim, ids, data, index, asked)``, asked being groups (query_ids, query_data, bounds)."""

    def run():
        so_far = Bounds(kind, k)

        def each(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]  # blocks are Python objects one at a time
                ids, data = unpack(row["ids"], row["data"], row["dim"])
                query_ids, query_data = (np.concatenate(x) for x in zip(*(unpack(g["query_ids"], g["query_data"], row["dim"]) for g in row["asked"]), strict=True))
                bounds = so_far.of(query_ids, np.concatenate([np.frombuffer(g["bounds"], np.float64) for g in row["asked"]]))
                q, v, s = kind.find(ids, data, row["index"], query_ids, query_data, bounds, k)
                so_far.add(q, s)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64() if kind.score == "long" else pa.float64())], names=["query_id", "vec_id", "score"])

        return each

    return arrow_map(pairs.select("dim", "ids", "data", "index", "asked"), f"query_id long, vec_id long, score {kind.score}", run)


def _together(groups: DataFrame, parts: int) -> DataFrame:
    """``(cell, block, asked)``: the groups that meet a block, in ``parts`` lists, so that a block is read a few times only."""
    group = F.struct("query_ids", "query_data", "bounds")
    dealt = groups.repartition("cell", "block").withColumn("s", F.pmod(F.xxhash64("query_ids"), F.lit(parts)))
    return dealt.groupBy("cell", "block", "s").agg(F.collect_list(group).alias("asked")).drop("s")


def _best(found: DataFrame, kind: Kind, k: int) -> DataFrame:
    order = F.desc("score") if kind.descending else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _opened(groups: DataFrame, balls: DataFrame, kind: Kind) -> DataFrame:
    """``(dim, cell, block, query_ids, query_data, bounds)``: for each group and block of another cell the queries whose bound leaves it open.

    The balls go to the groups, MOST_SENT at a time.
    """
    spark = groups.sparkSession
    parts = max(1, -(-balls.count() // MOST_SENT))
    out = None
    for i in range(parts):
        own = balls.where(F.pmod(F.xxhash64("cell", "block"), F.lit(parts)) == i).orderBy("cell", "block").collect()
        held = spark.sparkContext.broadcast([(r["dim"], r["cell"], r["block"], bytes(r["centre"]), r["radius"], r["most"]) for r in own])

        def make(held=held):
            def each(batch: pa.RecordBatch):
                by_dim: dict[int, list] = {}
                for b in held.value:
                    by_dim.setdefault(b[0], []).append(b)
                for row in batch.to_pylist():
                    near = [b for b in by_dim.get(row["dim"], ()) if b[1] != row["cell"]]
                    ids, data = unpack(row["ids"], row["data"], row["dim"])
                    bounds = np.frombuffer(row["bounds"], np.float64)
                    x = kind.space(data)
                    norms = (x**2).sum(1)
                    for a in range(0, len(near), 256):
                        some = near[a : a + 256]
                        centre = np.array([np.frombuffer(b[3], np.float64) for b in some])
                        radius, most = np.array([b[4] for b in some]), np.array([b[5] for b in some])
                        product = x @ centre.T
                        distance = np.sqrt(np.maximum(0.0, norms[:, None] + (centre**2).sum(1)[None, :] - 2 * product))
                        left = kind.open(distance, product, norms[:, None], radius[None, :], most[None, :], bounds[:, None]) | np.isnan(bounds)[:, None]
                        for j, b in enumerate(some):
                            at = np.flatnonzero(left[:, j])
                            if len(at):
                                yield pa.RecordBatch.from_arrays([pa.array([b[0]], pa.int32()), pa.array([b[1]], pa.int64()), pa.array([b[2]], pa.int32()), *(pa.array([y[at].tobytes()], pa.binary()) for y in (ids, data, bounds))], names=["dim", "cell", "block", "query_ids", "query_data", "bounds"])

            return each

        found = arrow_map(groups, "dim int, cell long, block int, query_ids binary, query_data binary, bounds binary", make)
        out = found if out is None else out.unionByName(found)
    return out


def search(queries: DataFrame, candidates: DataFrame, kind: Kind, k: int) -> DataFrame:
    """The ``k`` best candidates of each query: ``(query_id, rank, vec_id, score)``, ties to the smaller vec_id.

    Every query group meets the blocks of its own cell first; the k-th score found there is each query's bound, and in a
    second pass a block of another cell meets only the queries for which its ball may hold a better one. Queries and
    candidates are all their rows; of repeated queries of one id each row asks, and their finds are ranked together.
    """
    pivots = pivots_of(candidates)
    rows, asked = assigned(candidates, pivots), assigned(queries, pivots)
    many, asks = rows.count(), asked.count()
    none = F.lit(None).cast("double")
    indexed = _indexed(packed(rows.withColumn("bound", none), BLOCK, "block", many), kind)
    named = lambda groups: groups.select("dim", "cell", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), "bounds")
    blocks = indexed.select("dim", "cell", "block", "ids", "data", "index")
    first = packed(asked.withColumn("bound", none), GROUP, "part", asks)
    numbers = indexed.select("cell", "block")
    numbers = F.broadcast(numbers) if numbers.count() <= MOST_NUMBERS else numbers
    parts = -(-asks // ASKED)
    meeting = lambda groups: _met(_together(groups, max(1, parts)).join(blocks, ["cell", "block"]), kind, k)
    own = stored(_best(meeting(named(first).join(numbers, "cell")), kind, k))
    worst = F.min("score") if kind.descending else F.max("score")
    bound = own.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, worst).cast("double").alias("bound"))
    again = packed(asked.join(bound, "vec_id", "left"), GROUP, "part", asks)
    more = meeting(_opened(again.select("dim", "cell", "ids", "data", "bounds"), indexed.select("dim", "cell", "block", "centre", "radius", "most"), kind))
    # a candidate of two cells' meetings, or of two rows of one query, counts once for each of its rows
    out = _best(own.drop("rank").unionByName(more), kind, k)
    released(rows)
    return out
