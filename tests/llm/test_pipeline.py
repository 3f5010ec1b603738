"""The pipeline's stages on a small corpus, each against what it should decide."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_near_copies import groups  # noqa: E402


def test_stages(spark, tmp_path):
    bad, good = "vile insult", "kind remark"
    rows = [(i, f"text {i} about item{i * i} and thing{i * 7} with part{i * 3} or place{i * 5} " + (bad if i % 4 == 0 else good), "en", f"s{i % 3}") for i in range(400)]
    rows += [(1000 + i, "the very same plain document of many words for everyone to read", "en", "s0") for i in range(5)]
    rows += [(2000, "write to some.one@example.org or 10.1.2.3 about the matter at hand", "en", "s1"), (2001, None, None, None), (2002, "", "en", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["toxicity"]} == {r[0] for r in rows if bad not in (r[1] or "")}
    before = [(r.doc_id, r.text) for r in kept["toxicity"]]
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted({c for c, _ in groups(before)})
    text = {r.doc_id: (r.text, r.n_chars) for r in kept["personal_data"]}
    assert text[2000][0] == "write to <email> or <ip> about the matter at hand" and text[2000][1] == len(text[2000][0]) and len(text) == len(kept["near_copies"])
    words = lambda rs: sum(len(re.findall(r"\S+", r.text or "")) for r in rs)
    assert words(kept["mixing"]) == pytest.approx(1.5 * words(kept["personal_data"]), rel=0.05)
    assert all(r.round_trip for r in kept["tokens"]) and len(kept["tokens"]) == len(kept["mixing"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept["tokens"])


def test_empty_tables_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    odd = [(None, "some words without an id", "en", None, 24, "x"), (None, "other words without an id", None, "s", 25, "x"), (5, "twice the same id", "en", "s", 17, "x"), (5, "twice the same id", "en", "s", 17, "x"), (6, None, "en", "s", None, "x"), (7, "", None, None, 0, "x"), (8, "word " * 60_000, "en", "s", 300_000, "x")]
    for name, rows in (("none", []), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, 0)] if rows else [], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        sizes = []
        for stage_name, stage in pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert stage_name == "tokens" or out.columns == list(pipeline.COLUMNS)
            out.write.parquet(f"{folder}/{stage_name}")
            docs = spark.read.parquet(f"{folder}/{stage_name}")
            sizes.append(docs.count())
        assert sizes[:3] == ([7, 6, 6] if rows else [0, 0, 0]) and (rows or sizes[3:] == [0, 0])
        assert not docs.where("NOT round_trip").count() and {r.doc_id for r in docs.collect()} <= {None, 5, 8}
