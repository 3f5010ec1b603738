"""Language identification with word-first backoff.

A word that some language's table holds is scored by its log frequency in each language. Any other word falls back to
its character n-grams, from the longest size down, until one size has n-grams that some table holds. A text's score for
a language is the mean over its words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import arrow_map, texts_of

WORD = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
MOST_CACHED = 250_000


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: labelled rows read for each language (on average, chosen by hash), entries of each table, sizes of n-grams."""

    rows: int = 6000
    words: int = 20_000
    grams: int = 6000
    longest: int = 5


@dataclass(frozen=True)
class Model:
    """Scores of words and n-grams: for each entry its -log10 relative frequency by language, a penalty where it is missing."""

    languages: tuple[str, ...]
    tables: tuple[dict[str, int], ...]  # by size of n-gram, words at 0
    scores: tuple[np.ndarray, ...]

    def word(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return self.scores[0][known]
        framed = f" {word} "
        for n in range(len(self.tables) - 1, 0, -1):
            table = self.tables[n]
            found = [at for i in range(len(framed) - n + 1) if (at := table.get(framed[i : i + n])) is not None]
            if found:
                return self.scores[n][found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows of which nothing is learned; a null id is read as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(documents: DataFrame, limits: Limits = Limits()) -> Model:
    """Learns from the texts and non-null lang of rows that are not held out, Limits.rows for each language or all.

    What reaches the driver is bounded by the languages times Limits' entries.
    """
    labelled = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, limits.rows / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model((), ({},) * (limits.longest + 1), (np.zeros((0, 0), np.float32),) * (limits.longest + 1))
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    part = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    sample = labelled.where(dice < part[F.col("lang")]).select("lang", "text")

    def make():
        def each(batch: pa.RecordBatch):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "entry", "n"])

        return each

    words = arrow_map(sample, "lang string, entry string, n long", make).groupBy("lang", "entry").agg(F.sum("n").alias("n")).withColumn("size", F.lit(0))
    framed = F.concat(F.lit(" "), "entry", F.lit(" "))
    every = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(limits.longest)), lambda n: F.transform(
            F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - n + 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(n.alias("size"), F.substring(framed, i, n).alias("entry")),
        ))
    )
    grams = words.select("lang", "n", F.explode(every).alias("g")).groupBy("lang", F.col("g.entry").alias("entry"), F.col("g.size").alias("size")).agg(F.sum("n").alias("n"))
    both = words.unionByName(grams)
    by = Window.partitionBy("lang", "size")
    ranked = both.withColumns({"r": F.row_number().over(by.orderBy(F.desc("n"), "entry")), "total": F.sum("n").over(by)})
    kept = ranked.where(F.col("r") <= F.when(F.col("size") == 0, limits.words).otherwise(limits.grams)).select("lang", "size", "entry", F.log10(F.col("total") / F.col("n")).alias("s"))
    found = kept.toPandas()
    languages = tuple(sorted(share))
    column = {x: i for i, x in enumerate(languages)}
    tables, scores = [], []
    for size in range(limits.longest + 1):
        own = found[found["size"] == size]
        table: dict[str, int] = {}
        for entry in sorted(set(own["entry"])):
            table[entry] = len(table)
        # a missing entry costs more than any that is there
        grid = np.full((len(table), len(languages)), 1.0 + (own["s"].max() if len(own) else 0.0), np.float32)
        grid[own["entry"].map(table).to_numpy(np.int64), own["lang"].map(column).to_numpy(np.int64)] = own["s"].to_numpy(np.float32)
        tables.append(table)
        scores.append(grid)
    return Model(languages, tuple(tables), tuple(scores))


class Scorer:
    """Applies a model to texts; the scores of words met so far are kept under a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.grid = np.empty((4096, len(self.model.languages)), np.float32)

    def _place(self, word: str) -> int:
        i = len(self.at)
        if i == len(self.grid):
            self.grid = np.concatenate([self.grid, np.empty_like(self.grid)])
        self.grid[i] = self.model.word(word)
        self.at[word] = i
        return i

    def score(self, text: str) -> tuple[str, float]:
        """The language and its share, the softmax of the mean word scores; UNDETERMINED and 0 without letters."""
        words = WORD.findall(text.lower())
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.at) > MOST_CACHED:
            self.reset()
        get = self.at.get
        places = [i if (i := get(w)) is not None else self._place(w) for w in words]
        mean = self.grid[places].mean(axis=0, dtype=np.float64)
        best = int(mean.argmin())
        return self.model.languages[best], float(1.0 / np.exp((mean[best] - mean) * np.log(10.0)).sum())


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``documents(doc_id, text)``; only the text is scored.

    lang_pred is one of the model's languages, ties to the first by code point; ``und`` with score 0 for null texts,
    texts without a letter and a model without languages. Repeated rows give repeated rows, an empty table an empty one.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by Limits for each language

    def make():
        scorer = Scorer(held.value)

        def each(batch: pa.RecordBatch):
            found = [scorer.score(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return each

    rows = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return arrow_map(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)
