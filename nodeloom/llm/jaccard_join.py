"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH; Satuluri and Parthasarathy, 2012).

Documents are sets of word shingles. Those with equal sets form a class, of which one stands for all. A class's MinHash
values give banded keys, and classes that share a key are candidates. A candidate pair's values are compared a few at a
time; it is dropped as soon as the posterior probability that its similarity reaches the threshold is below a tolerance.
What is left is verified on the shingles themselves.

Pairs are never rows. A key's classes are dealt into cells of bounded size, and each two cells of a key meet in one task
that compares their signatures and gives a spanning forest of the survivors, fewer rows than members. Connected, these
make clusters, outside of which no candidate pair survives; a cluster's cells then meet with their shingles, and the
tasks count each class's verified links and give a spanning forest of them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.common import arrow_map, components, free_name, joined_to_keys, roots_of, slices, stored, texts_of

WORD = re.compile(r"\w+")
#: Bands and values in each. A pair of similarity s shares a key with probability 1 - (1 - s^4)^24: at 0.8 all but 3 in a million.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Classes in a cell, on average.
CELL = 512
MOST_CACHED = 120_000
SLICE = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_FACTORS = (_RANDOM.integers(1, 1 << 32, VALUES, dtype=np.uint64) | 1).astype(np.uint32)
_TERMS = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of hashed shingles of ``n`` words; a text with fewer words, but one at least, is one shingle."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text's shingles."""
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        get = self.known.get
        out = []
        for text in texts:
            h = np.array([found if (found := get(w)) is not None else self._word(w) for w in WORD.findall(text.lower())], np.uint64)
            if not len(h):
                out.append(h)
                continue
            width = min(self.n, len(h))
            mixed = h[: len(h) - width + 1].copy()
            for i in range(1, width):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + h[i : len(h) - width + 1 + i]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            out.append(np.unique(mixed ^ (mixed >> np.uint64(29))))
        return out


def class_of(shingles: np.ndarray) -> bytes | None:
    """A name of the set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima of the set's hashes under random linear maps."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, (h[a : a + 2048, None] * _FACTORS + _TERMS).min(axis=0), out=low)
    return low


@functools.lru_cache(4)
def least_matches(threshold: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n values with which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n match) is the chance of m or fewer successes in n + 1 draws of chance t.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the signatures ``a`` and ``b`` that are not dropped; with ``same`` those with i < j."""
    need = least_matches(threshold)
    left, right, matches = [], [], []
    for start in range(0, len(a), 128):  # the first values of all pairs, a strip at a time
        strip = np.zeros((len(a[start : start + 128]), len(b)), np.uint8)
        for v in range(STEP):
            strip += a[start : start + 128, v, None] == b[None, :, v]
        i, j = np.nonzero(strip >= need[0])
        left.append(i + start)
        right.append(j)
        matches.append(strip[i, j].astype(np.int32))
    i, j, m = np.concatenate(left), np.concatenate(right), np.concatenate(matches)
    if same:
        i, j, m = (x[i < j] for x in (i, j, m))
    for k, least in enumerate(need[1:], 1):
        if not len(i):
            break
        m = m + (a[i, k * STEP : (k + 1) * STEP] == b[j, k * STEP : (k + 1) * STEP]).sum(1)
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def similar(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of ``threshold`` at least, from the sets themselves."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    common = _many_common(sets_a, sets_b)[i, j] if len(i) > 4 * (len(sets_a) + len(sets_b)) else _common(sets_a, sets_b, i, j)
    return common >= threshold * (size_a[i] + size_b[j] - common) - 1e-9


def _common(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the pairs' intersections, one by one."""
    out = np.zeros(len(i), np.int64)
    for p, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        own, other = sets_a[x], sets_b[y]
        where = np.searchsorted(own, other)
        where[where == len(own)] = len(own) - 1
        out[p] = (own[where] == other).sum()
    return out


def _many_common(sets_a: list[np.ndarray], sets_b: list[np.ndarray], strip: int = 4096) -> np.ndarray:
    """The sizes of all intersections, by products of incidence matrices over strips of the shingles."""
    values, where = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets_a) + len(sets_b)), [len(s) for s in [*sets_a, *sets_b]])
    often = np.bincount(where, minlength=len(values)) > 1  # a shingle of one set is in no intersection
    number = np.cumsum(often) - 1
    kept = often[where]
    owner, column = owner[kept], number[where[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets_a), len(sets_b)), np.float64)
    for start in range(0, int(often.sum()), strip):
        a, b = np.searchsorted(column, [start, start + strip])
        held = np.zeros((len(sets_a) + len(sets_b), strip), np.float32)
        held[owner[a:b], column[a:b] - start] = 1.0
        out += held[: len(sets_a)] @ held[len(sets_a) :].T
    return out.astype(np.int64)


ROW = "__row"


def numbered(documents: DataFrame, name: str = ROW) -> DataFrame:
    """``documents`` with a number for each row, written once: a second scan of the same files may split and number them otherwise."""
    return stored(documents.withColumn(name, F.monotonically_increasing_id()))


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """``(__row, doc_id, class, signature, keys)`` of each row of ``documents(__row, doc_id, text)``.

    class: 16 bytes of the set's hash, null without words; signature: VALUES times 2 bytes; keys: one for each band.
    """
    steps = np.arange(BANDS, dtype=np.uint64) * _MIX

    def make():
        shingler = Shingler(n)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(2))
            names, signs, keys = [], [], []
            for a, b in slices([len(t) for t in texts], SLICE):
                for s in shingler.sets(texts[a:b]):
                    low = min_hashes(s)
                    names.append(class_of(s))
                    signs.append((low & 0xFFFF).astype(np.uint16).tobytes())
                    key = steps.copy()
                    for r in range(ROWS):
                        key = (key ^ (key >> np.uint64(31))) * _MIX + low[r::ROWS].astype(np.uint64)
                    keys.append(((key ^ (key >> np.uint64(29))) * _MIX).view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(signs, pa.binary()), lists], names=[ROW, "doc_id", "class", "signature", "keys"])

        return each

    schema = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return arrow_map(documents.select(ROW, F.col("doc_id").cast("long"), "text"), schema, make)


#: The largest bitmap that goes to the tasks, in bits (32 MB). Beyond it more rows pass; none is lost.
MOST_BITS = 1 << 28


def row_bitmap(rows: DataFrame) -> np.ndarray:
    """Bits at the hashes of the numbers in ``rows(__row)``, eight to a number up to MOST_BITS, gathered in pages of 4 KB."""
    bits = 1 << 15
    while bits < min(MOST_BITS, 8 * rows.count()):
        bits *= 2
    at = F.pmod(F.xxhash64(ROW), F.lit(bits)) + 1
    pages = rows.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def shingle_sets(documents: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``(node, shingles)``: the class and the set (8 bytes a shingle) of each row of ``documents(__row, text)`` that ``rows(__row)`` names, and of few others.

    A bitmap sorts the rows out where they are read, so that no text is shuffled.
    """
    bitmap = row_bitmap(rows)
    held = documents.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        shingler = Shingler(n)

        def each(batch: pa.RecordBatch):
            at = batch.column(0).to_numpy()
            texts = texts_of(batch.column(1).take(pa.array(np.flatnonzero(held.value[at >> 3] >> (at & 7) & 1))))
            for a, b in slices([len(t) for t in texts], SLICE):
                sets = shingler.sets(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

        return each

    numbers = documents.select(F.pmod(F.xxhash64(ROW), F.lit(8 * len(bitmap))).alias("at"), "text")
    return arrow_map(numbers, "node binary, shingles binary", make)


def dealt(members: DataFrame, key: str) -> DataFrame:
    """Members of ``key`` dealt into cells: ``members`` with ``cells``, their number, and ``cell``, the own one.

    A key with m members has about m / CELL cells. Keys with one member go; a hot key's number of cells goes to its members.
    """
    counts = stored(members.groupBy(key).agg(F.count("*").alias("m")).where("m > 1"))
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]
    cells = F.ceil(F.col("m") / CELL).cast("int")
    return joined_to_keys(members, counts, key, "m", total, "inner", alike=True).withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).drop("m")


def met(placed: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Each cell of ``key`` with every other: ``(key, x, y, cell, node, *payload)``, x <= y.

    Each member goes to each meeting of its cell, so no task gets more than about two cells.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    return placed.withColumn("other", other).select(key, F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "cell", "node", *payload)


def _forest(nodes_a: list[bytes], nodes_b: list[bytes], i: np.ndarray, j: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Edges (a, b) that connect what the pairs connect, fewer than there are nodes."""
    names = sorted({*nodes_a, *nodes_b})
    at = {n: k for k, n in enumerate(names)}
    a, b = np.array([at[n] for n in nodes_a], np.int64)[i], np.array([at[n] for n in nodes_b], np.int64)[j]
    roots = roots_of(a, b, len(names))
    moved = np.flatnonzero(roots != np.arange(len(names)))
    return [names[k] for k in moved], [names[k] for k in roots[moved]]


def _cells(batch: pa.Table) -> tuple[dict, dict, bool]:
    """The two cells of a meeting, in order of their nodes; the same one twice if a cell meets itself."""
    cols = batch.to_pydict()
    order = sorted(range(len(cols["node"])), key=lambda k: cols["node"][k])
    x, y = cols["x"][0], cols["y"][0]
    pick = [{c: [v[k] for k in order if cols["cell"][k] == side] for c, v in cols.items()} for side in ((x,) if x == y else (x, y))]
    return pick[0], pick[-1], x == y


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: edges that connect all candidate pairs that survive the pruning."""

    def meet(batch: pa.Table) -> pa.Table:
        a, b, same = _cells(batch)
        signs = [np.frombuffer(b"".join(c["signature"]), np.uint16).reshape(-1, VALUES) for c in (a, b)]
        if not len(signs[0]) or not len(signs[1]):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        left, right = _forest(a["node"], b["node"], *survivors(*signs, same, threshold))
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    keyed = reps.select("node", F.explode("keys").alias("key"))
    pairs = met(dealt(keyed, "key"), "key", [])
    return pairs.join(reps.select("node", "signature"), "node").groupBy("key", "x", "y").applyInArrow(meet, "a binary, b binary").distinct()


def verified_links(clustered: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, b)`` from ``(node, cluster, copies, signature)`` and each node's ``(node, shingles)``.

    Each meeting of two cells gives for a node the rows linked to it there and a neighbour ``b`` in the forest, or null.
    """

    def meet(batch: pa.Table) -> pa.Table:
        a, b, same = _cells(batch)
        if not a["node"] or not b["node"]:
            return pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "b": pa.array([], pa.binary())})
        signs = [np.frombuffer(b"".join(c["signature"]), np.uint16).reshape(-1, VALUES) for c in (a, b)]
        sets = [[np.frombuffer(x, np.uint64) for x in c["shingles"]] for c in (a, b)]
        i, j = survivors(*signs, same, threshold)
        keep = similar(*sets, i, j, threshold)
        i, j = i[keep], j[keep]
        copies_a, copies_b = np.array(a["copies"]), np.array(b["copies"])
        links = dict.fromkeys([*a["node"], *b["node"]], 0)
        for nodes, counts in ((a["node"], np.bincount(i, copies_b[j], len(copies_a))), (b["node"], np.bincount(j, copies_a[i], len(copies_b)))):
            for node, more in zip(nodes, counts.astype(int).tolist(), strict=True):
                links[node] += more
        links = {node: k for node, k in links.items() if k}
        forest = dict(zip(*_forest(a["node"], b["node"], i, j), strict=True))
        return pa.table({"node": pa.array(list(links), pa.binary()), "links": pa.array(list(links.values()), pa.int64()), "b": pa.array([forest.get(x) for x in links], pa.binary())})

    # the sets move once to their nodes and then to the meetings
    whole = dealt(clustered, "cluster").join(sets, "node")
    return met(whole, "cluster", ["copies", "signature", "shingles"]).groupBy("cluster", "x", "y").applyInArrow(meet, "node binary, links long, b binary")


def grouped(documents: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """near_duplicates for numbered documents: ``(__row, doc_id, class_id, n_links, copies, copy_of, kept)``.

    kept marks one row of each group: the smallest doc_id, then the smallest row number.
    """
    rows = stored(signatures(documents, n))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    classes = rows.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("node")).agg(head.alias("head"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    reps = stored(classes)
    clusters = components(candidate_edges(reps, threshold)).select("node", F.col("root").alias("cluster"))
    chosen = stored(reps.select("node", "head", "copies", "signature").join(clusters, "node"))
    # the sets of clustered classes, read from the first document of each
    sets = shingle_sets(documents.select(ROW, "text"), chosen.select(F.col(f"head.{ROW}").alias(ROW)), n)
    # a row that passes the bitmap by chance may be a copy of a chosen one
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    found = stored(verified_links(chosen.drop("head"), sets, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("b IS NOT NULL").select(F.col("node").alias("a"), "b")).select("node", "root")
    first = groups.join(reps.select("node", "head"), "node").groupBy("root").agg(F.min("head").alias("first"))
    classes = reps.select("node", "head", "copies").join(links, "node", "left").join(groups.join(first, "root").select("node", "first"), "node", "left")
    classes = classes.select(F.col("node").alias("class"), F.col("head.doc_id").alias("copy_of"), "copies", "links", F.coalesce("first", "head").alias("first"))
    # texts without words have no class and a class may have many copies: neither meets in one task
    out = joined_to_keys(rows.select(ROW, "doc_id", "class"), stored(classes), "class", "copies", rows.count())
    alone = F.col("class").isNull()
    return out.select(
        ROW, "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        (alone | (F.col(f"first.{ROW}") == F.col(ROW))).alias("kept"),
    )


def near_duplicates(documents: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``(doc_id, class_id, n_links, copies, copy_of)`` for each row of ``documents(doc_id, text)``.

    Words are lower-cased runs of letters, digits and underscores; shingles are ``n`` words, a shorter text being one
    shingle. n_links is the number of other rows with a Jaccard similarity of ``threshold`` at least; class_id is the
    smallest doc_id that a row reaches by such links, so rows share it exactly if links connect them. copies counts
    rows with the same set of shingles, itself included, and copy_of is their smallest doc_id. Null texts and texts
    without words link to nothing: class_id and copy_of are their own id. Repeated rows are rows of their own and link
    to each other; a null id is a class_id only where a group has no other. An empty table gives an empty one;
    other columns are left aside. A similar pair can be missed if no band matches or its values fall far below its
    similarity: at the threshold itself about 3 pairs in a million, and steeply fewer above it.
    """
    return grouped(numbered(documents.select("doc_id", "text")), threshold, n).drop(ROW, "kept")


def deduplicate(documents: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of ``documents`` without near copies: of each group that near_duplicates finds, its row of the smallest doc_id stays.

    Of several such rows one stays, and null ids come last. Null texts and texts without words are in no group and stay,
    also repeated ones. All columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    row = free_name(ROW, documents.columns)
    rows = numbered(documents, row)
    kept = grouped(rows.select(F.col(row).alias(ROW), "doc_id", "text"), threshold, n).where("kept").select(F.col(ROW).alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
