"""Encoding against the public library, and the exact round trip."""

import pytest

from stemma.llm import tokenizer

public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "Hello  world's  end\n\n\t x", "<|endoftext|> [PAD] <s>", "naïve 中文字 กขค 👨‍💻 é  　 ​", "x" * 50_000, "a " * 40_000, "1234567 3.14", "'s 'll don't", "\r\n \r\n", "tail   "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, ids int")


def test_same_ids_as_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(docs).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(spark, docs):
    got = tokenizer.decode_corpus(tokenizer.encode_corpus(docs), tokenizer.pieces(spark)).collect()
    assert {r.doc_id: r.text for r in got} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_empty_table_and_repeats(docs):
    assert tokenizer.encode_corpus(docs.limit(0)).count() == 0
    assert tokenizer.encode_corpus(docs.union(docs)).count() == 2 * len(TEXTS)


def test_blocks_of_any_size_give_the_same(docs, monkeypatch):
    whole = {r.doc_id: r.ids for r in tokenizer.encode_corpus(docs).collect()}
    monkeypatch.setattr(tokenizer, "BLOCK_WORDS", 1)
    assert {r.doc_id: r.ids for r in tokenizer.encode_corpus(docs).collect()} == whole
