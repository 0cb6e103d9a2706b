"""Byte-level BPE and alignment against plain loops over the tokenizers themselves."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import alignment, bpe, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


@cache
def plain():
    ranks = {
        base64.b64decode(a): int(b)
        for a, b in (x.split() for x in open(VOCABULARY, "rb"))
    }
    model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return model, {b: a for a, b in ranks.items()}


def digest(text: str | None) -> tuple:
    model, tokens = plain()
    ids = model.encode_ordinary(text or "")
    raw = b"".join(tokens[i] for i in ids)
    assert raw == (text or "").encode()
    packed = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()


# Texts whose chunks fall out of step: one pre-token fills an overlap, or a border lies in spaces,
# contractions or characters of many bytes.
HARD = [
    "a" * 900, "word " * 30 + "b" * 400 + " more words" * 60, " " * 500 + "end", "x's it'll 're " * 80,
    "\n\n \t" * 200, "ünïcödé 𝒳𝒴 漢字 " * 60, "1234567890" * 90, "-" * 40 + " ok " + "=" * 700 + " tail, and so on" * 20,
    "<|endoftext|>" * 40, "՘࢏ a" * 200, "don" + "'" * 300 + "t" + " w" * 200,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (50, 50), (200, 20)])
def test_chunks_give_the_ids_of_whole_texts(spark, awkward, chunk, overlap):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD + HARD[:3])], "doc_id long, text string")
    table = awkward.select("doc_id", "text").union(extra)
    found = bpe.digests(
        bpe.encoded(table, VOCABULARY, PATTERN, chunk=chunk, overlap=overlap), VOCABULARY
    ).collect()
    wanted = [(r.doc_id, *digest(r.text)) for r in table.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_equal_chunk_sizes_split_work_and_keep_results(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    table = spark.createDataFrame([(1, text), (2, text), (None, text)], "doc_id long, text string")
    rows = bpe.encoded(table, VOCABULARY, PATTERN, chunk=500, overlap=60).collect()
    ids = plain()[0].encode_ordinary(text)
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "None"] and all(r.ids == ids for r in rows)


def test_decoding_joins_raw_bytes(spark):
    ids = plain()[0].encode_ordinary("漢𝒳")
    parts = [(1, ids), (2, ids[:1]), (3, []), (4, None)]
    table = spark.createDataFrame(parts, "doc_id long, ids array<int>")
    found = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(table, VOCABULARY).collect()}
    assert found == {1: "漢𝒳".encode(), 2: plain()[1][ids[0]], 3: b"", 4: b""}


def test_boundaries_are_those_of_the_encoder():
    find = bpe.boundaries(PATTERN)
    model = plain()[0]

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.sampled_from("ab 's1\n!\t漢 ՘'ll"), max_size=60) | st.text(max_size=30))
    def check(text):
        text = text.encode("utf-8", "replace").decode()
        ends = find(text)
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(parts) == text
        assert sum((model.encode_ordinary(p) for p in parts), []) == model.encode_ordinary(text)

    check()


def test_empty_tables(spark, nothing):
    assert bpe.digests(bpe.encoded(nothing, VOCABULARY, PATTERN), VOCABULARY).count() == 0
    found = alignment.scored(alignment.aligned(nothing, VOCABULARY, PATTERN, PIECES))
    assert found.count() == 0 and "count_sum" in found.columns


@pytest.mark.parametrize("name", ["op12_byte_bpe"])
def test_registered_encoding(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = queries.queries()[name](spark, small).collect()
    assert {tuple(r) for r in found} == {(r.doc_id, *digest(r.text)) for r in docs}
    assert len(found) == len(docs)


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    """The contract's columns by loops over tokens and their byte ends."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_bytes = plain()[1]

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    worked = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            a = b = []
        ends = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(b_bytes(i)))):
            at, found = 0, {}
            for n, i in enumerate(ids):
                at += size(i)
                found[at] = n
            ends.append(found)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in shared]
        groups, x, y = [], 0, 0
        for e in shared:
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        worked.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(link for w in worked for link in w[4])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (
            doc_id, n_a, n_b, len(groups), len(links),
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, n_a, n_b, groups, links in worked
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_awkward_texts(spark, awkward):
    odd = [(2000, "a▁b"), (2001, "  two  spaces"), (2002, "<|endoftext|> <s> <0x41>"), (2003, "\u0000\u0001"), (2004, " ")]
    table = awkward.select("doc_id", "text").union(
        spark.createDataFrame(odd + list(enumerate(HARD, 3000)), "doc_id long, text string"))
    found = alignment.scored(alignment.aligned(table, VOCABULARY, PATTERN, PIECES))
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    wanted = plain_alignment([tuple(r) for r in table.collect()])
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=key) == sorted(wanted, key=key)
    texts = {r.doc_id: r for r in found.collect()}
    assert texts[2000].n_a == 0 and texts[2000].groups_sha256 == texts[2000].groups == ""
    assert all(r.groups.count("|") == r.n_groups for r in texts.values())


def test_alignment_of_the_registered_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = queries.queries()["op13_token_alignment"](spark, small)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == sorted(plain_alignment([tuple(r) for r in docs]))


def test_pairs_looked_up_by_shuffle_give_the_same(spark, small, monkeypatch):
    """Beyond the size that may be broadcast, with hot pairs spread over salts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = alignment.aligned(docs, VOCABULARY, PATTERN, PIECES, groups=False)
    wanted = sorted(map(tuple, alignment.scored(rows).select(COLUMNS).collect()))
    monkeypatch.setattr("chronoloom.operators.lookup.BROADCAST_ROWS", 10)
    spark.conf.set("spark.chronoloom.hotRows", "20")
    try:
        found = alignment.scored(rows).select(COLUMNS).collect()
    finally:
        spark.conf.unset("spark.chronoloom.hotRows")
    assert sorted(map(tuple, found)) == wanted


def test_overlaps_of_random_cuts():
    import pandas as pd

    chance = np.random.default_rng(3)
    for _ in range(20):
        sides, cuts, base = [[], []], [[], []], 0
        for doc in range(3):
            size = int(chance.integers(1, 30))
            for side in (0, 1):
                inner = chance.choice(np.arange(1, size), min(size - 1, 6), replace=False) if size > 1 else []
                at = [0, *sorted(int(x) for x in inner)]
                for s, e in zip(at, [*at[1:], size]):
                    sides[side].append((doc, base + s))
                    cuts[side].append((base + s, base + e))
            base += size
        a, b = (
            pd.DataFrame({"doc": [d for d, _ in s], "at": [x for _, x in s], f"row_{n}": range(len(s))})
            for s, n in zip(sides, "ab")
        )
        found = list(zip(*(x.tolist() for x in alignment.overlaps(a, b))))
        wanted = {
            (i, j) for i, (s, e) in enumerate(cuts[0]) for j, (t, f) in enumerate(cuts[1])
            if s < f and t < e
        }
        assert len(found) == len(set(found)) and set(found) == wanted


def test_columns_of_other_names(spark):
    table = spark.createDataFrame([("k", "some text")], "id string, body string")
    ids = bpe.encoded(table, VOCABULARY, PATTERN, doc_id="id", text="body")
    assert ids.first().ids == plain()[0].encode_ordinary("some text")
    rows = alignment.aligned(table.withColumn("pairs", F.lit(1)), VOCABULARY, PATTERN, PIECES, doc_id="id", text="body")
    assert rows.first().doc_id == "k" and rows.first().n_groups == 2
