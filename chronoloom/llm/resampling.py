"""Target-distribution importance resampling: draw the documents most like a target's texts.

Words are cut with Arrow kernels over whole batches: ascii_lower, split_pattern_regex,
list_flatten and dictionary_encode give every word an index; neighbouring indices of one document
form the bigrams. Only the distinct words and bigrams of a batch are hashed (CRC32), into a fixed
number of buckets. One pass counts buckets over the corpus and over the target; a second takes
each feature's gain by index and adds the gains up per document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut
from chronoloom.operators.ranges import numbered

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
# What lies between words: ASCII but for digits and (after lower-casing) letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of text worked on at a time; a longer text is worked on alone.
_BLOCK = 1 << 23
_RESULT = ["doc_id", "n_features", "weight", "score", "rank"]


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column with about ``_BLOCK`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _BLOCK, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _crcs(words: list[bytes], first: list[int] | None = None) -> list[int]:
    return [zlib.crc32(w) for w in words] if first is None else list(map(zlib.crc32, words, first))


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bucket of each feature, words of each row): the row and bucket of every word and
    every pair of neighbouring words of a column of texts, in order of rows; null texts have none.
    """
    # Not cast before: a cast slice keeps its offsets, which Arrow's ascii_lower takes to begin at 0.
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lowered, SEPARATORS)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    coded = pc.dictionary_encode(flat.filter(some))
    row = row.filter(some).to_numpy().astype(np.int64)
    word = coded.indices.to_numpy().astype(np.int64)
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = _crcs(distinct)
    of_word = np.array(crc, dtype=np.int64)[word] % buckets if len(word) else word
    near = row[1:] == row[:-1]
    shifted = pc.dictionary_encode(pa.array((word[:-1] * len(distinct) + word[1:])[near]))
    left, right = np.divmod(shifted.dictionary.to_numpy(), max(len(distinct), 1))
    begun = _crcs([b" "] * len(distinct), crc)
    pair = _crcs([distinct[i] for i in right.tolist()], [begun[i] for i in left.tolist()])
    of_pair = np.array(pair, dtype=np.int64) % buckets
    of_pair = of_pair[shifted.indices.to_numpy()] if len(pair) else of_pair
    rows = np.concatenate([row, row[1:][near]])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([of_word, of_pair])[order], np.bincount(row, minlength=len(texts))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, *, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0)):
                found += np.bincount(features(block, buckets)[1], minlength=buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(found[used])], ["bucket", "n"]
        )

    counted = texts.select(text).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, *, text: str = "text") -> list[int]:
    """The gain of each bucket: the floored thousandfold logarithm of how much likelier it is in
    the target than in the corpus, with one added to every bucket. A list as long as ``buckets``,
    whatever the corpus holds."""
    counts = []
    for table in (corpus, target):
        row = [0] * buckets
        for bucket, n in bucket_counts(table, buckets, text=text).collect():
            row[bucket] = n
        counts.append(row)
    s, t = counts
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [
        math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)
    ]


def weighed(docs: DataFrame, gain: list[int], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``weight`` is the floored mean of its
    features' gains."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, dtype=np.int64)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                rows, bucket, n_words = features(block, len(gain))
                n = np.bincount(rows, minlength=len(block))
                sums = np.zeros(len(block), dtype=np.int64)
                if len(rows):
                    has = n > 0
                    starts = (np.cumsum(n) - n)[has]
                    sums[has] = np.add.reduceat(table.take(bucket), starts)
                weight = sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)),
                     *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )
                at += len(block)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, from the hash of the seed and the id; a null id draws as an
    empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with at least ``least_words`` words, the ``percent`` hundredths with the highest
    score are drawn and ranked from 1, ties to the smaller id; other rows have a null rank. Defined
    cases: null texts and texts without words have no features and weight 0; a null id draws as an
    empty one and ranks before others of its score; equal rows are ranked one after the other; other columns are
    ignored; empty tables (either) give what the formulas give, an empty ``docs`` an empty table.
    """
    gain = gains(docs, target, buckets, text=text)
    rows = weighed(docs, gain, doc_id=doc_id, text=text).withColumn(
        "score", F.col("weight") + luck(F.col("doc_id"), seed)
    )
    rows = cut(rows)
    # Rows that nothing tells apart go through the order as one, with their number.
    fit = (
        rows.filter(F.col("n_words") >= least_words)
        .groupBy("doc_id", "n_features", "weight", "score")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"),
             F.col("weight")]
    placed = numbered(fit, order, "rank", copies="copies")
    most = percent * placed.count() // 100
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*_RESULT).unionByName(rest.select(*_RESULT))
