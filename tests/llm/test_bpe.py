"""Ids against the reference tokenizer of the rank file, exact round trips, split characters."""

import random

import public_tokenizers
import pytest
import tiktoken

from codeloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in ranks.items()}, special_tokens={}
    )


def texts():
    draw = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "é", "中", "!", "\xa0", "\x0b", "᠎", "​", "\x1c"]
    parts += ["\x85", "😀", "﻿", "<|endoftext|>", "$"]
    odd = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    return [None, "", "word " * 30_000, "x" * 5000, "é\xa0 " * 40_000, *odd]


def test_ids_offsets_and_round_trip(spark, own):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    found = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, offsets="at"), RANKS)
    assert found.count() == len(rows)
    for r in found.collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        tokens = [own.decode_single_token_bytes(i) for i in r.ids]
        assert r.at == [sum(map(len, tokens[:k])) for k in range(len(tokens))] if len(tokens) < 60 else r.at[0] == 0


def test_split_characters(own):
    ids = own.encode_ordinary("a😀中\U0001f9ff")
    table = bpe.bytes_by_id(bpe.read_ranks(RANKS))
    pieces = bpe.decode_pieces(ids, table)
    assert "".join(pieces) == "a😀中\U0001f9ff" and "" in pieces
    assert bpe.decode_pieces(ids[:-1], table)[-1].endswith("�")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(df, RANKS, public_tokenizers.PATTERN).count() == 0
