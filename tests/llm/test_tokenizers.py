"""Token counts, encodings and decodings against the public libraries."""

import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nodeloom.llm import piece_bpe, token_count

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
library = Tokenizer.from_file(WORDS)
processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ODD = [
    "", "   ", "\n\n \n", "it's they're 'tis ''s I'll x's's don't!'s", "a<|endoftext|>b<|startoftext|><|endoftext|>", "ΣΑΣ İstanbul ﬁ ½ 1234 ٣٤", "你好世界 😀👍🏽 \x00\x1c a\x85b",
    "a" * 3000, "ab" * 2000 + "'s", "é" * 700, "▁ ▁▁ x▁", " " * 37, "<s> </s> <unk> <0x0A>",
]
ALPHABET = "abcdefgstvrlm''   \n.!?0123éüßñÉ你😀ΣİⅣ²́‍<|>▁"


def count(texts):
    return token_count.machine(WORDS).counts(texts).tolist()


def test_counts_of_odd_texts():
    assert count(ODD) == [len(e.ids) for e in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=80), max_size=8).map(lambda x: [*x, "a"]))
def test_counts(texts):
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_without_a_word_end(monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 7)
    random.seed(3)
    texts = ["".join(random.choice("thesandwich") for _ in range(n)) for n in (1, 6, 7, 8, 50, 500)]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_full_tables_start_anew(monkeypatch):
    machine = token_count.Machine(WORDS)
    monkeypatch.setattr(token_count, "MOST_STATES", 3)
    assert machine.counts(["some words"]).tolist() == machine.counts(["some words"]).tolist() == [2]


@pytest.mark.parametrize(("most", "block"), [(1 << 17, 64), (40, 64), (40, 1 << 20)])
def test_tables_stay_bounded_inside_a_word(monkeypatch, most, block):
    monkeypatch.setattr(token_count, "MOST_STATES", most)
    monkeypatch.setattr(token_count, "BLOCK", block)
    monkeypatch.setattr(token_count, "CHUNK", 16)
    machine = token_count.Machine(WORDS)
    random.seed(8)
    texts = ["".join(random.choice("etaoinshrd") for _ in range(3000)), "plain words it's 12", "x" * 1000, "word " * 100]
    assert machine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(machine.configs) <= 2 * most


def test_a_word_of_megabytes():
    machine = token_count.Machine(WORDS)
    random.seed(9)
    word = "".join(random.choice(("the", "an", "tion", "ing", "q", "zx")) for _ in range(900_000))
    text = word + " end"
    assert len(word) > 2_000_000
    assert machine.counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert len(machine.configs) <= 2 * token_count.MOST_STATES


def test_clashing_columns_of_counts(spark):
    docs = spark.createDataFrame([(1, "two words", 9, "x", True)], "doc_id long, text string, n_tokens int, n_bytes string, over_limit boolean")
    assert [tuple(r) for r in token_count.count_tokens(docs, WORDS).collect()] == [(1, 9, 2, False)]


def test_encoding_of_odd_texts():
    own = piece_bpe.model(PIECES)
    assert [own.encode(t) for t in ODD] == processor.encode(ODD)
    assert [own.decode(own.encode(t)) for t in ODD] == [processor.decode(i) for i in processor.encode(ODD)]


@settings(max_examples=100, deadline=None)
@given(st.text(ALPHABET, max_size=120))
def test_encoding(text):
    own = piece_bpe.model(PIECES)
    ids = own.encode(text)
    assert ids == processor.encode(text) and own.decode(ids) == processor.decode(ids) == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_decoding_any_ids(ids):
    assert piece_bpe.model(PIECES).decode(ids) == processor.decode(ids)


def test_queries(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Hello world.\nNext", None), (5, "word " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, WORDS).collect())
    assert got == [(0, 17, len(library.encode("Hello world.\nNext", add_special_tokens=False).ids), False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (5, 15000, 3000, True)]
    both = piece_bpe.decode(piece_bpe.encode(docs, PIECES), PIECES).collect()
    assert all(r.ids == processor.encode(r.text or "") and r.decoded == (r.text or "") for r in both) and len(both) == 5
    assert piece_bpe.encode_digests(docs.where("false"), PIECES).count() == token_count.count_tokens(docs.where("false"), WORDS).count() == 0


def digests(text):
    ids = processor.encode(text or "")
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), processor.decode(ids)))


def test_digests_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_CACHED", 50)
    random.seed(5)
    odd = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 200))) for _ in range(300)]
    texts = [*ODD, None, "\nx", " \nx", "a \n b\n\nc.\n", "  a  b", "word.*** word", "x" * 200_000, *odd, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS decoded", "2 AS ids")
    got = piece_bpe.encode_digests(docs, PIECES).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id]) for r in got)
    both = piece_bpe.round_trip(docs, PIECES)
    assert sorted(both.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    assert all(r.n_tokens == "x" and r.ids == processor.encode(r.text or "") and r.decoded == processor.decode(r.ids) for r in both.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_documents_against_the_libraries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = piece_bpe.encode_digests(docs, PIECES).collect()
    assert len(got) == docs.count() and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(text[r.doc_id]) for r in got)
    ids = sorted(text)
    want = dict(zip(ids, (len(e.ids) for e in library.encode_batch([text[i] or "" for i in ids], add_special_tokens=False)), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, WORDS).collect()} == want
