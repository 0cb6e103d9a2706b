"""The pipeline and the registered queries of this part."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest

import __spark_entry__ as contract
from chronoloom.llm import queries
from chronoloom.llm.common import fresh
from compare import difference, duck

COLUMNS = {
    "op1_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_": "doc_id fingerprint component_id",
    "op3_": "doc_id size source_size target taken",
    "op4_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_": "page_id host path rule verdict",
    "op6_": "doc_id path own_licence score inherited_licence inherited_from licence",
    "op7_": "page_id url text n_chars",
    "op8_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_": "query_id rank vec_id score",
    "op10_": "doc_id n_bytes shard depth shard_bytes shard_rows",
}


@pytest.mark.parametrize("start", COLUMNS)
def test_registered_queries_return_their_columns(spark, small, start):
    (name,) = (n for n in contract.queries() if n.startswith(start))
    found = contract.queries()[name](spark, small)
    assert found.columns == COLUMNS[start].split()
    assert found.count() > 0


def test_quality_rules_match_their_sql(spark, small):
    name = "op1_quality_rules"
    found = contract.queries()[name](spark, small)
    assert difference(found, contract.oracle_sql()[name], duck(small)) is None


def test_all_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(contract.queries())


def test_pipeline_stages_against_plain_references(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    seen = {"start": rows}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, small)
        if name != "pack":
            assert found.columns == docs.columns
        table = spark.createDataFrame(found.collect(), found.schema)
        docs, seen[name] = table, table.collect()
    failed = {i for i, r in rows.items() if brute.measures(r.text)[-1]}
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert not kept & failed and all(rows[r.doc_id] == r for r in seen["quality_rules"])
    groups = brute.components({i: brute.fingerprint(rows[i].text) for i in kept}, 2)
    assert {r.doc_id for r in seen["near_duplicates"]} == set(groups.values())
    wanted = brute.repeats([(i, rows[i].text.encode()) for i in set(groups.values())], 100)
    assert len(seen["repeated_passages"]) == len(wanted)
    for r in seen["repeated_passages"]:
        size, gone, *_ = wanted[r.doc_id]
        assert size - gone - 3 * wanted[r.doc_id][2] - 3 <= len(r.text.encode()) <= size - gone
        assert r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in seen["repeated_passages"]}
    times = Counter(r.doc_id for r in seen["mix"])
    assert max(times.values()) <= 3 and all(texts[r.doc_id] == r.text for r in seen["mix"])
    assert Counter(r.doc_id for r in seen["pack"] if r.piece == 0) == times


def test_pipeline_runs_whole(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.columns == COLUMNS["op4_"].split() and found.count() > 0


def test_fresh_names(spark):
    table = spark.createDataFrame([(1, 2)], "`_A` int, `_a1` int")
    assert fresh(table, "a", "b") == ["_a2", "_b"]
