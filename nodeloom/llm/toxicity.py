"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import arrow_map, give_back, released, slices, stored, texts_of

WORD = re.compile(r"\w+")
#: Letters of a stem.
STEM = 5
MOST_CACHED = 120_000
SLICE = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Settings:
    """rows: labelled documents read (on average, chosen by hash), characters: of them (likewise); bits: of the hashed feature space; then FTRL's own."""

    rows: int = 16_000
    characters: int = 60_000_000
    bits: int = 22
    passes: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0


@dataclass(frozen=True)
class Weights:
    """The features with a weight, and the bias; None: nothing was learned."""

    bits: int
    features: np.ndarray
    values: np.ndarray
    bias: float | None


class Hasher:
    """Features of texts, each hashed to ``bits`` bits.

    Words, and the stems of longer ones (their first STEM letters, so that inflected forms share a feature),
    neighbouring words, and words with one between them.
    """

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}
        self.words = np.empty((1 << 16, 2), np.uint64)

    def _word(self, word: str) -> int:
        i = len(self.known)
        if i == len(self.words):
            self.words = np.concatenate([self.words, np.empty_like(self.words)])
        self.words[i] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word[:STEM], 1)
        self.known[word] = i
        return i

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text's number, feature), repeats included."""
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        get = self.known.get
        words = [WORD.findall(t.lower()) for t in texts]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(w) for w in words])
        at = np.fromiter((found if (found := get(w)) is not None else self._word(w) for ws in words for w in ws), np.int64, len(owner))
        h = self.words[at, 0]
        own, out = [owner, owner], [(h * _MIX[0]) >> self.shift, (self.words[at, 1] * _MIX[0]) >> self.shift]
        for gap in (1, 2):
            same = owner[gap:] == owner[:-gap]
            pair = (h[:-gap] * _MIX[gap] ^ (h[gap:] + _MIX[0])) * _MIX[1 + (gap == 1)]
            own.append(owner[gap:][same])
            out.append((pair[same] * _MIX[0]) >> self.shift)
        return np.concatenate(own), np.concatenate(out).astype(np.int32)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learned; a null id is read as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(rows: list[tuple[np.ndarray, int]], settings: Settings) -> Weights:
    """FTRL-proximal over (distinct features, label), in the given order, Settings.passes times."""
    if not rows:
        return Weights(settings.bits, np.zeros(0, np.int32), np.zeros(0, np.float32), None)
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = np.where(np.abs(own) <= settings.l1, 0.0, -(own - np.sign(own) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))
        w[-1] = -own[-1] / ((settings.beta + math.sqrt(n[bias])) / settings.alpha)  # the bias bears no penalty
        return w

    for _ in range(settings.passes):
        for features, label in rows:
            at = np.append(features, bias)
            w = weights(at)
            gradient = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w.sum())))) - label
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += squared
    kept = np.append(np.flatnonzero(np.abs(z[:-1]) > settings.l1), bias)
    w = weights(kept)
    return Weights(settings.bits, kept[:-1].astype(np.int32), w[:-1].astype(np.float32), float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Weights:
    """Learns from the texts of labelled rows that are not held out: Settings.rows of them and Settings.characters, or all.

    A document with several labels counts as toxic if one says so; rows that repeat an id with its text are learned once.
    Features are hashed on the executors; the fit itself is one task over the sample, bounded in rows and in bytes, in
    order of the hashes of ids and texts, and returns the weights that are not zero. Null ids have no label. Without
    labelled rows, as in empty tables, nothing is learned.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, settings.rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < share)
    # at most about Settings.rows rows of two numbers
    met = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    found = stored(met.groupBy(F.xxhash64("doc_id", "text").alias("h")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")))
    size = found.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    part = min(1.0, settings.characters / max(1, size))
    chosen = found.where(F.pmod(F.xxhash64("h"), F.lit(1_000_003)) / 1_000_003 < part).select("h", "toxic", "text")

    def hashed():
        hasher = Hasher(settings.bits)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(2))
            parts: list[np.ndarray] = []
            for a, b in slices([len(t) for t in texts], SLICE):
                owner, feature = hasher.features(texts[a:b])
                pairs = np.unique(owner.astype(np.int64) << settings.bits | feature)
                ends = np.searchsorted(pairs >> settings.bits, np.arange(b - a + 1))
                flat = (pairs & ((1 << settings.bits) - 1)).astype(np.int32)
                parts += [flat[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(parts, pa.binary())], names=["h", "toxic", "features"])

        return each

    def learned(batches):
        rows = [(h, f, y) for b in batches for h, y, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1]))
        w = train([(np.frombuffer(f, np.int32), int(y > 0)) for _, f, y in rows], settings)
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_pydict({"features": [w.features.tobytes()], "values": [w.values.tobytes()], "bias": pa.array([w.bias], pa.float64())})

    ready = arrow_map(chosen, "h long, toxic int, features binary", hashed)
    row = ready.repartition(1).mapInArrow(learned, "features binary, values binary, bias double").first()
    released(found)
    return Weights(settings.bits, np.frombuffer(row["features"], np.int32), np.frombuffer(row["values"], np.float32), row["bias"])


class Scorer:
    def __init__(self, weights: Weights):
        self.bias = weights.bias
        self.hasher = Hasher(weights.bits)
        self.dense = np.zeros(1 << weights.bits, np.float32)
        self.dense[weights.features] = weights.values

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities that the texts are toxic; 0 where nothing was learned."""
        if self.bias is None:
            return np.zeros(len(texts))
        owner, feature = self.hasher.features(texts)
        weighty = np.flatnonzero(self.dense[feature])
        pairs = np.unique(owner[weighty].astype(np.int64) << 32 | feature[weighty])
        total = np.bincount(pairs >> 32, self.dense[pairs & 0xFFFFFFFF].astype(np.float64), len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -500.0, 500.0)))


def score(documents: DataFrame, weights: Weights, column: str = "toxicity") -> DataFrame:
    """``documents`` with the score of each whole text in ``column`` (0 to 1), in place of one of that name.

    Null and empty texts have no features, so their score is that of the bias; without labelled rows every score is 0.
    A row comes for each row; other columns stay as they are.
    """
    held = documents.sparkSession.sparkContext.broadcast(weights)  # at most 2 ** bits numbers
    rest = documents.drop(column)
    at = rest.columns.index("text")

    def make():
        scorer = Scorer(held.value)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            found = [scorer.scores(texts[a:b]) for a, b in slices([len(t) for t in texts], SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*batch.schema.names, column])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return arrow_map(rest, f"{schema}, `{column}` double", make)


def classify(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``documents(doc_id, text)``; labels serve the fit only.

    predicted is 1 for scores of 0.5 and more, ties included. Null and empty texts get the bias's score, repeated rows
    one each, an empty table none; other columns are left aside.
    """
    scored = score(documents.select(F.col("doc_id").cast("long"), "text"), fit(documents, labels, settings))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
