"""The Jaccard join and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import jaccard_join
from nodeloom.llm.common import components


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """(smallest id reached, links) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(least.get(find(i), rows[i][0]) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # a large group of near copies
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:30] + [rng.choice(words) for _ in range(90)])) for i in range(20)]  # a shared passage
    rows += [(200 + i, "An exact, exact copy of one short text") for i in range(15)]
    rows += [(300, None), (301, ""), (302, " .,! "), (303, "one"), (304, "One!"), (305, "one two"), (None, "one two"), (303, "one"), (310, "long " * 30000)]
    return rows


@pytest.mark.parametrize("cell", [512, 8])
def test_join(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    want = sorted(((doc, c, n) for (doc, _), (c, n) in zip(rows, groups(rows), strict=True)), key=key)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()), key=key) == want
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({c for _, c, _ in want}) and sorted(i for i in ids if i is not None) == sorted({c for _, c, _ in want})


def test_scans_that_split_files_otherwise(spark, tmp_path, monkeypatch):
    rows = corpus()
    for i in range(6):
        spark.createDataFrame(rows[i::6], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    split = lambda n: spark.conf.set("spark.sql.files.minPartitionNum", n)

    def fewer_cores(edges):  # between the scan for signatures and the one for sets
        split(1)
        return components(edges)

    monkeypatch.setattr(jaccard_join, "components", fewer_cores)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    want = sorted(((doc, c, n) for (doc, _), (c, n) in zip(rows, groups(rows), strict=True)), key=key)
    try:
        split(12)
        numbers = docs.rdd.getNumPartitions()
        split(1)
        assert spark.read.parquet(f"{tmp_path}/d").rdd.getNumPartitions() < numbers
        split(12)
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()), key=key) == want
        split(12)
        ids = sorted(r.doc_id for r in jaccard_join.deduplicate(docs).collect() if r.doc_id is not None)
        assert ids == sorted({c for _, c, _ in want})
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    assert jaccard_join.near_duplicates(spark.read.parquet(f"{tmp_path}/d")).count() == 0


def test_common_counts_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(30)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert jaccard_join._common(sets, sets, i, j).tolist() == want
    assert jaccard_join._many_common(sets, sets, 64)[i, j].tolist() == want


def test_pruning_keeps_what_is_similar():
    need = jaccard_join.least_matches(0.8)
    assert need == sorted(need) and need[0] >= 1
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (1, jaccard_join.VALUES)).astype(np.uint16)
    b = np.repeat(a, 2000, 0)
    b[rng.random(b.shape) > 0.8] += 1
    assert len(jaccard_join.survivors(a, b, False, 0.8)[0]) == 2000


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
