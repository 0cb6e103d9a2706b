"""Ids of texts that hold the strings of special tokens, by the vocabulary file as it is."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronoloom.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n", " <|endoftext|>  \n", "<|end"]


def test_special_tokens_are_those_of_the_vocabulary(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert 50256 in ids[0]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        encode = packing.encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
        assert {i: encode(t).tolist() for i, t in enumerate(TEXTS)} == ids
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.packed(table, path, pattern=public_tokenizers.PATTERN).collect()
    wanted = {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for i, x in ids.items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == wanted
