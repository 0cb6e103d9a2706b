"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; a source takes whole epochs
first and then, in key order, documents up to the rest of its budget. Keys are ordered through
ranges of its logarithm, which hold some 5,000 documents at most whatever the weights, sums per
range, and a running sum inside each. No source, however large, is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, fresh, word_count
from chronoloom.operators.lookup import lookup_join

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3.0
BUCKET_ROWS = 5_000
SEED = 20_240_229


def quality(text: Column, size: Column) -> Column:
    """Weight of a document in (0, 1]: low for few words and for many symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    clean = F.lit(1.0) - F.try_divide(symbols.cast("double"), size)
    long_enough = F.least(F.lit(1.0), size / F.lit(50.0))
    return F.greatest(F.lit(0.05), F.coalesce(clean, F.lit(0.0)) * long_enough)


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES
) -> DataFrame:
    """(source, source_size, n) with ``target``: shares by weight, none above its cap.

    Sources in code point order, null last, take the weights in turn. With t = cap / weight sorted
    ascending, the first source whose share of what the capped ones leave stays under its cap fixes
    the level for all after it: resharing until nothing is above, in closed form. One row per
    source goes through the two windows here, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*(F.lit(float(w)) for w in weights))
    rank = F.row_number().over(by_name) - 1
    shared = sizes.withColumn(
        "weight", F.element_at(given, (rank % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(most_times))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, all_weights = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    right = all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    fill = F.when(left / right <= F.col("cap") / F.col("weight"), left / right)
    settled = shared.withColumn("fill", fill)
    # Later sources pass the test too; the level that holds is the first in order.
    first = F.first("fill", ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return settled.withColumn("level", first).select(
        "source",
        "source_size",
        "n",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias(
            "target"
        ),
    )


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """Exponential draw over the quality weight; depends on seed, id and text alone."""
    body = F.coalesce(text, F.lit(""))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, body), 11) + F.lit(0.5)) / F.lit(
        float(1 << 53)
    )
    return -F.log(u) / quality(body, word_count(text))


def _range(key: Column, n: Column) -> Column:
    """The number of a key's range, in order of keys.

    A quality only shifts the logarithm of an exponential draw, whose density is nowhere above 1/e.
    So with n rows, ranges of e * BUCKET_ROWS / n in the logarithm hold BUCKET_ROWS rows at most
    (expected), whatever qualities the source mixes.
    """
    scale = F.greatest(F.lit(1.0), n / F.lit(math.e * BUCKET_ROWS))
    return F.floor(F.log(F.greatest(key, F.lit(1e-300))) * scale)


def _decided(drawn: DataFrame, weights: Sequence[float], most_times: float) -> DataFrame:
    """``drawn`` with source_size, target, epochs and ``once_more``, decided by running sums."""
    sizes = drawn.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    goals = targets(sizes, weights, most_times)
    epochs = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    budgets = cut(
        goals.withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "of_source")
    )
    placed = lookup_join(drawn, budgets, {"source": "of_source"}, null_safe=True).withColumn(
        "bucket", _range(F.col("key"), F.col("n"))
    )
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_bucket.select(
        F.col("source").alias("sum_source"),
        F.col("bucket").alias("sum_bucket"),
        F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("before_bucket"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    same_bucket = F.col("source").eqNullSafe(F.col("sum_source")) & (
        F.col("bucket") == F.col("sum_bucket")
    )
    return placed.join(offsets, same_bucket).withColumn(
        "once_more", before + F.col("size") / 2 <= F.col("rest")
    )


def mixed(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_times: float = MOST_TIMES,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``copies``, ``taken``.

    A source with target t and size s gives each document floor(t / s) times and, in key order,
    once more while the running sum keeps to the rest of t; the document on the border is taken
    when that brings the sum nearer. Defined cases: a null text has size 0; null is a source of its
    own; sources of size 0 have target 0; a null id, repeated rows and equal ids are documents of
    their own; other columns are ignored; an empty table gives an empty table. Keys depend on seed,
    id and text alone, so reruns agree.
    """
    drawn = cut(_drawn(docs, doc_id, text, source, seed))
    times = F.col("epochs") + F.when(F.col("once_more"), 1).otherwise(0)
    return (
        _decided(drawn, weights, most_times)
        .withColumn("copies", times.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        _key(F.col(doc_id), F.col(text), seed).alias("key"),
    )


def mixed_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_times: float = MOST_TIMES,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes them, with their own columns.

    The same decisions as :func:`mixed`, brought to the texts as one row per source (its epochs
    and its last key taken once more), so no text is shuffled. Rows equal in id and text that lie
    on the border are all taken.
    """
    drawn = cut(_drawn(docs, doc_id, text, source, seed))
    last = F.max(F.when(F.col("once_more"), F.struct("key", "doc_id")))
    per_source = cut(
        _decided(drawn, weights, most_times)
        .groupBy("source")
        .agg(F.max("epochs").alias("epochs"), last.alias("last"))
    )
    of_source, epochs, limit, copy = fresh(docs, "of_source", "epochs", "limit", "copy")
    rules = per_source.select(
        F.col("source").alias(of_source), F.col("epochs").alias(epochs), F.col("last").alias(limit)
    )
    mine = F.struct(
        _key(F.col(doc_id), F.col(text), seed).alias("key"), F.col(doc_id).alias("doc_id")
    )
    times = F.col(epochs) + F.when(mine <= F.col(limit), 1).otherwise(0)
    return (
        lookup_join(docs, rules, {source: of_source}, null_safe=True)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        .select(*docs.columns)
    )
