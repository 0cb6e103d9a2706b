"""Importance resampling against a plain version of its formulas."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from chronoloom.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text: str | None, buckets: int) -> tuple[int, list[int]]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs, target, buckets=10_000, percent=25, least=20):
    held = [(i, *buckets_of(t, buckets)) for i, t in docs]
    s = Counter(x for _, _, f in held for x in f)
    t = Counter(x for text in target for x in buckets_of(text, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for i, n_words, found in held:
        weight = sum(gain[x] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, n_words])
    fit = sorted((r for r in rows if r[4] >= least),
                 key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_registered_query_against_plain_formulas(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = queries.queries()["op11_importance_resampling"](spark, small)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(found.collect()) == ordered(plain(docs, target))


def test_awkward_rows(spark, awkward):
    target = spark.createDataFrame([("the word1 of Thing1 passage7",), (None,), ("",)], "text string")
    found = resampling.resampled(awkward, target, percent=50).collect()
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(found) == ordered(plain(docs, [r.text for r in target.collect()], percent=50))


def test_empty_tables(spark, awkward, nothing):
    assert resampling.resampled(nothing, awkward).count() == 0
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    found = resampling.resampled(awkward, nothing).collect()
    assert ordered(found) == ordered(plain(docs, []))


def test_equal_rows_take_ranks_one_after_the_other(spark):
    text = " ".join(f"w{i}" for i in range(30))
    table = spark.createDataFrame([(1, text)] * 40 + [(2, text)] * 8, "doc_id long, text string")
    found = resampling.resampled(table, table, percent=100).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 49))


@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_blocks_do_not_change_features(monkeypatch, block):
    monkeypatch.setattr(resampling, "_BLOCK", block)
    texts = ["One two, two ONE!", None, "", "ünï cöde 漢字", "a-b_c9{x}~", "x " * 50, "..."]
    column = pa.array(texts, pa.string())
    at, seen = 0, []
    for part in resampling._blocks(column):
        rows, bucket, n_words = resampling.features(part, 10_000)
        for i in range(len(part)):
            seen.append((n_words[i], sorted(bucket[rows == i].tolist())))
        at += len(part)
    assert at == len(texts)
    assert seen == [(n, sorted(f)) for n, f in (buckets_of(t, 10_000) for t in texts)]


@pytest.mark.parametrize("start", [0, 1, 8, 16])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_later_slices_of_a_column_without_nulls(start, kind):
    texts = [f"One{i} two, ÜN{i} {'word ' * i}" for i in range(24)]
    column = pa.array(texts, kind).slice(start)
    rows, bucket, n_words = resampling.features(column)
    found = [(n_words[i], sorted(bucket[rows == i].tolist())) for i in range(len(column))]
    assert found == [(n, sorted(f)) for n, f in (buckets_of(t, 10_000) for t in texts[start:])]


def test_batches_of_more_bytes_than_a_block(spark):
    texts = [f"Doc{i} " + " ".join(f"w{(i * j) % 997}" for j in range(40)) for i in range(30)]
    texts += [f"Long{i} " + f"some{i} Words " * 300_000 for i in range(3)]
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    target = ["some1 Words w1 w2", "doc3"]
    found = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"))
    assert ordered(found.collect()) == ordered(plain(docs, target))
