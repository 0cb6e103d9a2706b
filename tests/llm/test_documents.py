"""Operators on documents against plain references, with awkward rows and empty tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import licenses, mixing, packing, quality, sharding, simhash, suffixes
from chronoloom.llm.components import connected
from compare import duck

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(small):
    return duck(small).execute("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# -- quality rules -------------------------------------------------------------------------


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures(docs, texts):
    found = {r.doc_id: tuple(r[c] for c in MEASURED) for r in quality.judged(docs).collect()}
    assert found == {i: brute.measures(t) for i, t, _ in texts}


def test_measures_of_awkward_rows(awkward):
    found = Counter((r.doc_id, *(r[c] for c in MEASURED)) for r in quality.judged(awkward).collect())
    assert found == Counter((r.doc_id, *brute.measures(r.text)) for r in awkward.collect())


def test_rules_follow_the_labels(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert len(rows) > 100 and all(r.kept == (r.quality == 1) for r in rows)


def test_kept_documents(docs, awkward, nothing):
    for table in (docs, awkward, nothing):
        kept = quality.kept_documents(table)
        assert kept.schema == table.schema
        assert kept.count() == quality.judged(table).filter("kept").count()


def test_a_rule_of_ones_own(awkward):
    strict = [quality.Rule("none", "n_words", high=-1)]
    assert not quality.judged(awkward, rules=strict).filter("kept").count()
    assert quality.judged(awkward, rules=[]).filter("kept").count() > 0


# -- near-duplicates -----------------------------------------------------------------------


def test_fingerprints_and_components(docs, texts):
    prints = {i: brute.fingerprint(t) for i, t, _ in texts}
    groups = brute.components(prints, 2)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_planted_distances(spark):
    base = 0x0123456789ABCDEF
    flips = {1: 0, 2: 1 << 63, 3: (1 << 63) | 1, 4: 0b111, 5: 0b111 | 1 << 40, 6: 0b11111111 << 20}
    prints = {i: base ^ f for i, f in flips.items()}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    pairs = simhash.links(spark.createDataFrame(signed, "doc_id int, bits long"))
    roots = {r.node: r.root for r in connected(pairs).collect()}
    groups = brute.components(prints, 2)
    for i, a in signed:
        for j, b in signed:
            same = roots.get(a, a) == roots.get(b, b)
            assert same == (groups[i] == groups[j])


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 5), (2000, 2001)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 0, 2000: 2000, 2001: 2000}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert {4, 5, 6} <= zero
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    one = simhash.one_of_each(awkward)
    assert one.schema == awkward.schema
    kept = [r.doc_id for r in one.collect()]
    assert len(kept) == len(set(kept)) == len({r.component_id for r in rows})
    assert simhash.one_of_each(nothing).count() == 0


# -- mixing --------------------------------------------------------------------------------


def check_mix(rows):
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    goals, taken, largest = brute.targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= largest[s] / 2 + 1e-6


def test_mix(docs, texts):
    rows = mixing.mixed(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(brute.WORD.findall(t or "")) for i, t, _ in texts}
    check_mix(rows)
    assert sorted(rows) == sorted(mixing.mixed(docs.repartition(5)).collect())


def test_mix_with_many_key_ranges(docs, monkeypatch):
    whole = sorted(mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(mixing.mixed(docs).collect()) == whole


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == awkward.count()
    check_mix(rows)
    assert mixing.mixed(nothing).count() == 0


def test_mixed_documents_follow_the_decisions(docs, nothing):
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}
    found = mixing.mixed_documents(docs)
    assert found.schema == docs.schema
    assert Counter(r.doc_id for r in found.collect()) == copies
    assert mixing.mixed_documents(nothing).count() == 0


def test_targets_by_many_sizes(spark):
    chance = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{i}": int(chance.integers(0, 1000) ** 2) for i in range(8)} | {None: 5}
        rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
        found = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert found == pytest.approx(brute.targets(sizes))


# -- packing -------------------------------------------------------------------------------


def check_packed(rows, texts, capacity=1024):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids = np.append(encode(text or ""), 2).astype("<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(pieces):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert n == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces) == 1)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(docs, texts):
    rows = packing.packed(docs, VOCABULARY, pattern=public_tokenizers.PATTERN).collect()
    used, total = check_packed(rows, [(i, t) for i, t, _ in texts])
    assert used <= total / 1024 * 1.01 + 2


def test_packing_in_many_districts(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "DISTRICT", 20)
    rows = packing.packed(docs, VOCABULARY, pattern=public_tokenizers.PATTERN).collect()
    used, total = check_packed(rows, [(i, t) for i, t, _ in texts])
    assert used <= total / 1024 * 1.05 + 2


def test_packing_of_awkward_rows(awkward, nothing):
    how = {"pattern": public_tokenizers.PATTERN}
    rows = packing.packed(awkward, VOCABULARY, **how).collect()
    assert sum(r.piece == 0 for r in rows) == awkward.count()
    only = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(packing.packed(only, VOCABULARY, **how).collect(), [(r.doc_id, r.text) for r in only.collect()])
    assert packing.packed(nothing, VOCABULARY, **how).count() == 0


@lru_cache
def _encoders():
    return (
        packing.encoder(public_tokenizers.path("byte_bpe_50k.json")),
        packing.encoder(VOCABULARY, public_tokenizers.PATTERN),
    )


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "a  b\n\n c", " x", "'s 12 x"]))
def test_both_vocabulary_files_give_the_same_ids(text):
    one, other = _encoders()
    clean = text.encode("utf-8", "ignore").decode()
    assert one(clean).tolist() == other(clean).tolist()


def test_crossover_keeps_all_pieces():
    import random

    sizes = np.random.default_rng(5).integers(1, 700, 300)
    a = packing.best_fit(sizes, 1024, np.argsort(-sizes))
    b = packing.best_fit(sizes, 1024, np.arange(300))
    for seed in range(10):
        child = packing.crossed(a, b, sizes, 1024, random.Random(seed))
        assert np.bincount(child, weights=sizes).max() <= 1024
        assert set(child) == set(range(child.max() + 1))


def test_search_beats_or_equals_best_fit():
    sizes = np.random.default_rng(6).integers(200, 520, 400)
    plain = packing.best_fit(sizes, 1024, np.argsort(-sizes, kind="stable"))
    found = packing.evolved(sizes, 1024, 1, [])
    assert packing.cost(found, sizes, 1024) <= packing.cost(plain, sizes, 1024)


# -- licences ------------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    prose = " ".join(["word"] * 100)
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x", prose), (3, "a/b/c/y", prose + "\nLicensed under CC BY-NC 4.0."),
        (4, "a/b/c/LICENSE.txt", prose + "\nLicensed under the Apache License, Version 2.0."),
        (5, "a/b/c/d/z", prose), (6, "e/f", prose), (7, None, None),
        (8, "a/b/q", "This work is licensed under the GNU General Public License, version 3."),
        (9, "ab/n", "no licence to be seen here, said the permission"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, place string, text string")
    found = {r.doc_id: r for r in licenses.scanned(docs, F.col("place")).collect()}
    assert {i: r.own_licence for i, r in found.items() if r.own_licence} == {
        1: "MIT", 3: "CC-BY-NC-4.0", 4: "Apache-2.0", 8: "GPL-3.0",
    }
    assert {i: (r.inherited_licence, r.inherited_from) for i, r in found.items()} == {
        1: ("MIT", "a"), 2: ("GPL-3.0", "a/b"), 3: ("Apache-2.0", "a/b/c"),
        4: ("Apache-2.0", "a/b/c"), 5: ("Apache-2.0", "a/b/c"), 6: (None, None),
        7: (None, None), 8: ("GPL-3.0", "a/b"), 9: (None, None),
    }
    assert found[3].licence == "CC-BY-NC-4.0" and found[2].licence == "GPL-3.0"


def test_licence_lines_of_the_documents(docs, texts):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = {r.doc_id: r.own_licence for r in licenses.scanned(docs, path).collect()}
    assert len(found) == len(texts)
    names = {
        "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT",
        "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0",
    }
    for i, text, _ in texts:
        named = {licence for name, licence in names.items() if name in text}
        assert (found[i] in named) if named else found[i] in (None, "proprietary")


def test_licences_of_awkward_rows(awkward, nothing):
    rows = licenses.scanned(awkward, F.col("source")).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.own_licence} == {-3}
    assert licenses.scanned(nothing, F.col("source")).count() == 0


# -- repeats -------------------------------------------------------------------------------


REMOVED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def removed(df):
    return {r.doc_id: tuple(r[c] for c in REMOVED) for r in df.collect()}


def test_repeats(docs, texts):
    wanted = brute.repeats([(i, (t or "").encode()) for i, t, _ in texts], 100)
    assert removed(suffixes.repeats_removed(docs)) == wanted


@pytest.mark.parametrize("length", [3, 10, 40])
def test_repeats_of_random_texts(spark, length):
    chance = np.random.default_rng(length)
    pool = ["".join(chance.choice(list("abü"), 60)) for _ in range(6)]
    texts = [
        "".join(
            pool[chance.integers(6)][: chance.integers(5, 60)] if chance.random() < 0.6
            else "".join(chance.choice(list("xyz€"), chance.integers(1, 30)))
            for _ in range(chance.integers(0, 8))
        )
        for _ in range(80)
    ]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute.repeats([(i, t.encode()) for i, t in rows], length)
    assert removed(suffixes.repeats_removed(table, length=length)) == wanted


def test_repeats_around_a_frequent_passage(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", 3)
    rows = [(i, f"{i * 7919 % 1000:x}-{i % 7} {'p q r s t u v w' * 9} {i * i:x} tail{i % 5}") for i in range(60)]
    wanted = brute.repeats([(i, t.encode()) for i, t in rows], 50)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(suffixes.repeats_removed(table, length=50)) == wanted


@pytest.mark.parametrize("crowded", [4, 1 << 15])
def test_repeats_around_a_crowded_line(spark, monkeypatch, crowded):
    """A line shorter or little longer than the length, amid texts that differ and some copies."""
    monkeypatch.setattr(suffixes, "FREQUENT", 3)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "BATCH", 7)
    line = "0123456789 abcdefghij klmnopqrst uvwxyz"
    for size in (len(line), 52):
        common = (line + " and more of the same")[:size]
        rows = [(i, f"{i * i:09x}{i % 3} {common}{i % 2} {i * 7919:09x}" * (1 + i % 2)) for i in range(90)]
        wanted = brute.repeats([(i, t.encode()) for i, t in rows], 50)
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert removed(suffixes.repeats_removed(table, length=50)) == wanted


def test_no_group_holds_the_texts_around_a_common_line(monkeypatch):
    """Of 4,000 documents with one line of 60 bytes, a run sends no two that would meet."""
    import pyarrow as pa

    line = "all of these documents hold this very line of sixty bytes..."
    table = pa.table({
        "run": pa.array([0] * 4000, pa.int32()), "doc_id": pa.array(range(4000), pa.int64()),
        "text": [f"{i * 7919:020d}{i:020d} {line} {i * 104729:020d}{i:020d}" for i in range(4000)],
        "rest": [None] * 4000,
    })
    counted = suffixes._counter(100, 4)(table)
    repeated = pa.concat_tables(
        [suffixes._repeats(counted.filter(pa.compute.equal(counted["range"], r))) for r in range(4)]
    )
    sent = suffixes._sender(100, 4)(table, repeated)
    keys = []
    for blob in sent.filter(pa.compute.invert(sent["local"]))["blob"]:
        deltas = suffixes._unsqueezed(blob.as_py())[0]
        keys += np.cumsum(np.frombuffer(deltas, dtype="<u8"), dtype=np.uint64).tolist()
    assert len(keys) >= 4000 and max(Counter(keys).values()) <= suffixes.FREQUENT


def test_the_merged_order_settles_what_repeats():
    """Equal strings follow from the prefixes between neighbours and nothing else."""
    same = np.array([-1, 6, 6])
    args = (np.arange(3), np.zeros(3, dtype=np.int64), np.full(3, 4), [b"abcd", b"xbcd", b"abcd"], 10)
    item, back = suffixes.covered(same, *args)
    assert sorted(zip(item.tolist(), back.tolist())) == [(2, 4)]
    item, back = suffixes.covered(np.array([-1, 7, 8]), *args)
    assert sorted(zip(item.tolist(), back.tolist())) == [(1, 3), (2, 2), (2, 3), (2, 4)]
    item, back = suffixes.covered(np.array([-1, 5, -1]), *args)
    assert len(item) == 0


def test_repeats_of_awkward_rows(awkward, nothing):
    rows = suffixes.repeats_removed(awkward).collect()
    assert len(rows) == awkward.count()
    twice = sorted(r.n_removed for r in rows if r.doc_id == 2)
    assert len(twice) == 2 and twice[0] == twice[1] == next(r.n_bytes for r in rows if r.doc_id == 2)
    assert next(r for r in rows if r.doc_id == 9).n_removed >= len("passage") * 30
    only = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    wanted = brute.repeats([(r.doc_id, (r.text or "").encode()) for r in only.collect()], 100)
    assert removed(suffixes.repeats_removed(only)) == wanted
    assert suffixes.repeats_removed(nothing).count() == 0


def test_deduplicated_keeps_columns(awkward):
    found = suffixes.deduplicated(awkward)
    assert found.columns == awkward.columns
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].text == next(r.text for r in awkward.collect() if r.doc_id == 1)
    assert rows[2].text == "" and rows[2].rest == "x" and rows[2].bits == "b"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=3, max_size=3).map(lambda b: bytes(c % 3 for c in b)), max_size=8), min_size=1, max_size=9))
def test_loser_tree_merges_with_prefixes(runs):
    class Plain:
        def __init__(self, strings):
            self.strings, self.at = sorted(strings), -1

        def advance(self):
            self.at += 1
            if self.at == len(self.strings):
                return None
            now = self.strings[self.at]
            return now, suffixes.common_prefix(self.strings[self.at - 1], now, 0) if self.at else 0

        def item(self):
            return self.strings[self.at]

    found = list(suffixes.merged([Plain(r) for r in runs]))
    assert [s for _, s in found] == sorted(x for r in runs for x in r)
    for (_, a), (same, b) in zip(found, found[1:]):
        assert same == suffixes.common_prefix(a, b, 0)


# -- sharding ------------------------------------------------------------------------------


def check_shards(rows, limit):
    totals, counts = Counter(), Counter()
    for r in rows:
        totals[r.shard] += r.n_bytes
        counts[r.shard] += 1
    for r in rows:
        assert (r.shard_bytes, r.shard_rows) == (totals[r.shard], counts[r.shard])
        assert r.shard.bit_length() - 1 == r.depth
        assert r.shard_bytes <= limit or r.shard_rows == 1
    # Only a bucket above the limit was split, and no shard lies inside another.
    labels = set(totals)
    for s in labels:
        assert not any(s >> d in labels for d in range(1, s.bit_length()))
        if s > 1:
            inside = [x for x in labels if x.bit_length() >= s.bit_length() and x >> (x.bit_length() - s.bit_length() + 1) == s >> 1]
            assert sum(totals[x] for x in inside) > limit and sum(counts[x] for x in inside) > 1


@pytest.mark.parametrize("limit", [10**9, 50_000, 3_000])
def test_shards(docs, texts, limit):
    rows = sharding.sharded(docs, limit=limit).collect()
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t, _ in texts}
    check_shards(rows, limit)


def test_shards_of_awkward_rows(spark, awkward, nothing):
    rows = sharding.sharded(awkward, limit=500).collect()
    assert len(rows) == awkward.count()
    check_shards(rows, 500)
    same = spark.createDataFrame([(1, "x" * 100)] * 200, "doc_id long, text string")
    check_shards(sharding.sharded(same, limit=1000).collect(), 1000)
    assert sharding.sharded(nothing).count() == 0


def test_documents_that_are_no_copies_stay_whatever_their_ids(spark):
    """Rows without an id, or that share one, are documents of their own; a copy without an id goes."""
    texts = [" ".join(f"{w}{i * 7 % 53}" for i in range(80)) for w in ("ant", "bee", "cat", "dog", "elk")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (7, texts[3]), (7, texts[4])]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = simhash.one_of_each(table).collect()
    assert sorted(r.n for r in kept) == [0, 1, 3, 4, 5]


def test_equal_rows_are_one_document(spark):
    text = " ".join(f"fox{i}" for i in range(60))
    table = spark.createDataFrame([(3, text, n) for n in range(50)] + [(4, text, 99)], "doc_id long, text string, n int")
    kept = simhash.one_of_each(table.repartition(5)).collect()
    again = simhash.one_of_each(table.repartition(3)).collect()
    assert len(kept) == 1 and kept == again and kept[0].doc_id == 3


@pytest.mark.parametrize("words", [1, 2, 400])
def test_key_ranges_are_even_for_any_quality(spark, words):
    """Short texts have a quality of 0.05 and much larger keys; a mix of both is even too."""
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("the word of it " * words)).otherwise(F.lit("x")).alias("text"),
    )
    keyed = rows.withColumn("key", mixing._key(F.col("doc_id"), F.col("text"), 7))
    sizes = keyed.groupBy(mixing._range(F.col("key"), F.lit(60_000)).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 1.2 * mixing.BUCKET_ROWS
    low = keyed.groupBy(mixing._range(F.col("key"), F.lit(60_000)).alias("b")).agg(
        F.min("key").alias("low"), F.max("key").alias("high")).orderBy("b").collect()
    assert all(a.high <= b.low for a, b in zip(low, low[1:]))


def test_shards_carry_the_rows(spark, docs, awkward, nothing):
    for table in (docs, awkward, nothing):
        found = sharding.sharded_documents(table, limit=3000)
        *columns, shard = found.columns
        assert columns == table.columns and shard == "shard"
        rows = [tuple(r) for r in found.collect()]
        assert Counter(r[:-1] for r in rows) == Counter(tuple(r) for r in table.collect())
        place = [columns.index("doc_id"), len(columns)]
        digest = sharding.sharded(table, limit=3000).collect()
        assert Counter(tuple(r[i] for i in place) for r in rows) == Counter((r.doc_id, r.shard) for r in digest)
    clash = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, Shard int")
    assert sharding.sharded_documents(clash).columns == ["doc_id", "text", "Shard", "_shard"]


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(None, "copy" * 25)] * 700 + [(i, "x" * (i % 90)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 3, 16):
        dealt = sharding.sharded(table.repartition(parts), limit=250).collect()
        check_shards(dealt, 250)
        found.append(Counter((r.doc_id, r.n_bytes, r.shard) for r in dealt))
    assert found[0] == found[1] == found[2]


def test_more_copies_than_hash_bits_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CONTENT_BITS", 4)
    monkeypatch.setattr(sharding, "PLACE_BITS", 11)
    monkeypatch.setattr(sharding, "BITS", 15)
    rows = [(1, "x" * 100)] * 1025 + [(i, "y" * 60) for i in range(200)]
    dealt = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), limit=150).collect()
    assert len(dealt) == len(rows)
    check_shards(dealt, 150)


def test_a_run_takes_few_bytes_of_memory_for_each_byte_of_text(monkeypatch):
    """Work on a run of the suffix sort holds no column of whole numbers for all its bytes."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(suffixes, "_CHUNK", 1 << 14)
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(1000)]
    table = pa.table({
        "run": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts)), pa.int64()),
        "text": texts, "rest": pa.array([None] * len(texts), pa.int32()),
    })
    size = sum(map(len, texts))
    # The first half of each text, in two blobs with ranges that overlap and touch.
    starts = np.arange(0, size, 4000)
    covered = pa.table({"blob": pa.array([
        suffixes._span_blob(np.concatenate([starts, starts + 500]), 1000),
        suffixes._span_blob(starts + 1500, 500),
    ], pa.binary())})
    schema = pa.schema([
        ("doc_id", pa.int64()), ("rest", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()),
    ])
    peaks = []
    for work in (
        lambda: suffixes.Texts(table).anchors(100),
        lambda: suffixes._cutter(schema, False)(table, covered),
    ):
        tracemalloc.start()
        try:
            found = work()
            peaks.append(tracemalloc.get_traced_memory()[1] / size)
        finally:
            tracemalloc.stop()
    assert set(found["n_removed"].to_pylist()) == {2000} and set(found["n_spans"].to_pylist()) == {1}
    assert max(peaks) < 6, peaks
