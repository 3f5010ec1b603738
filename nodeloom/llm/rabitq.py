"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each block's vectors are taken relative to the block's mean, scaled to length 1, rotated at random and reduced to signs.
With o the unit vector and s its code as a unit vector, a query's unit vector q has <o, q> = <s, q> / <o, s> up to an
error of about sqrt((1 - <o, s>^2) / <o, s>^2 / (dim - 1)), whatever the data. <s, q> comes from packed bits: the query
is rounded to BITS-bit integers, and each bit plane meets the codes by AND and popcount. The stored scalars (length,
<o, s>, count of ones) turn it into a distance with an error bound of ERROR such deviations. The vectors whose lower
bound is not above the k-th distance so far are measured exactly: that of the FIRST * k that look nearest in a query's
own block, and that of its whole first pass in the blocks around other pivots.
"""

from __future__ import annotations

import functools
import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.vector_blocks import Kind, first_of_each, search, usable

BITS = 6
#: Standard deviations that the error bound spans.
ERROR = 1.9
#: Times k vectors are measured to begin with.
FIRST = 4
SEED = 20240517
SLACK = 1e-9
#: Queries whose bounds are held at a time, and pairs that are measured at a time.
AT_ONCE, PAIRS = 64, 8192


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every block."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(data: np.ndarray) -> dict[str, np.ndarray]:
    """Codes and correction scalars of a block's vectors."""
    dim = data.shape[1]
    mean = data.mean(0)
    moved = data - mean
    length = np.sqrt((moved**2).sum(1))
    unit = moved / np.where(length > 0, length, 1.0)[:, None]
    turned = unit @ rotation(dim)
    signs = turned > 0
    fit = np.abs(turned).sum(1) / np.sqrt(dim)  # <o, s>
    fit = np.where(length > 0, fit, 1.0)
    return {"mean": mean, "code": _words(signs), "length": length, "fit": fit, "ones": signs.sum(1).astype(np.int64)}


def bounds(parts: dict[str, np.ndarray], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distances from each of ``queries``, or from one, to a block's vectors."""
    dim = queries.shape[-1]
    moved = np.atleast_2d(queries) - parts["mean"]
    reach = np.sqrt((moved**2).sum(1))[:, None]
    turned = (moved / np.where(reach > 0, reach, 1.0)) @ rotation(dim)
    low, high = turned.min(1)[:, None], turned.max(1)[:, None]
    step = (high - low) / ((1 << BITS) - 1)
    step = np.where(step > 0, step, 1.0)
    whole = np.rint((turned - low) / step).astype(np.int64)
    hits = np.zeros((len(moved), len(parts["length"])), np.int32)
    code = parts["code"].T.copy()
    for b in range(BITS):
        planes = _words((whole >> b & 1).astype(bool))
        for w in range(len(code)):
            hits += np.bitwise_count(code[w] & planes[:, w, None]).astype(np.int32) << b
    # <s, q> with s = (2 * bit - 1) / sqrt(dim) and q = low + step * whole
    product = (2 * step * hits + 2 * low * parts["ones"] - step * whole.sum(1)[:, None] - low * dim) / np.sqrt(dim)
    estimate = product / parts["fit"]
    fit2 = parts["fit"] ** 2
    # the query's rounding errors, of variance step^2 / 12, meet a code of length 1
    error = ERROR * (np.sqrt(np.maximum(0.0, 1 - fit2) / max(1, dim - 1)) + step / np.sqrt(12)) / parts["fit"]
    base = parts["length"] ** 2 + reach**2
    swing = 2 * parts["length"] * reach
    least, most = base - swing * np.minimum(1.0, estimate + error), base - swing * np.maximum(-1.0, estimate - error)
    return (least, most) if queries.ndim > 1 else (least[0], most[0])


def _index(data: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **encode(data))
    return out.getvalue()


def _measured(data: np.ndarray, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (query i, vector j)."""
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        apart = data[j[a : a + PAIRS]] - queries[i[a : a + PAIRS]]
        out[a : a + PAIRS] = np.einsum("ij,ij->i", apart, apart)
    return out


def _find(ids, data, index, query_ids, queries, bounds_, k):
    with np.load(io.BytesIO(index)) as found:
        parts = dict(found)
    out = [(query_ids[:0], ids[:0], np.zeros(0))]
    for a in range(0, len(query_ids), AT_ONCE):
        own, v, bound = query_ids[a : a + AT_ONCE], queries[a : a + AT_ONCE], bounds_[a : a + AT_ONCE]
        low, high = bounds(parts, v)
        other = ids != own[:, None]
        most = bound**2 * (1 + SLACK)  # the k-th distance so far rules out more than this block's own would
        new = np.flatnonzero(np.isnan(bound))
        most[new] = np.inf
        chosen = np.zeros(low.shape, bool)
        if len(new) and len(ids) > FIRST * k:
            middle = np.where(other[new], low[new] + high[new], np.inf)
            first = np.argpartition(middle, FIRST * k, axis=1)[:, : FIRST * k]
            near = _measured(data, v, np.repeat(new, FIRST * k), first.ravel()).reshape(first.shape)
            near[~other[new[:, None], first]] = np.inf
            most[new] = np.partition(near, k - 1, axis=1)[:, k - 1]
            chosen[new[:, None], first] = True
        chosen |= low <= most[:, None]
        i, j = np.nonzero(chosen & other)
        near = _measured(data, v, i, j) <= most[i] * (1 + SLACK)
        i, j = i[near], j[near]
        distance = np.sqrt(((data[j] - v[i]) ** 2).sum(1))
        q, found_, score = first_of_each(i, ids[j], distance, distance, k)
        out.append((own[q], found_, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _open(distance, product, norms, radius, most, bounds):
    return distance - radius <= bounds * (1 + SLACK) + SLACK * np.sqrt(norms + most)


DISTANCES = Kind(_index, lambda data: data, _find, _open, "double", False)


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query, score the Euclidean distance, ties to the smaller vec_id.

    Queries are the ids divisible by ``every``; the rows of a repeated id ask each, and their finds are ranked together.
    Candidates are all rows of ``embeddings(vec_id, embedding)`` with another id and as many components, all if fewer
    than k. Null, empty and zero vectors, null ids and vectors with a null or non-finite component take no part. Repeated rows are candidates each. An empty table
    gives an empty one; other columns are left aside.
    """
    rows = usable(embeddings).where(F.exists("v", lambda x: x != 0))
    return search(rows.where(F.col("vec_id") % every == 0), rows, DISTANCES, k)
