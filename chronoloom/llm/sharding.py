"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash code. All rows begin in one bucket, and only
a bucket whose bytes exceed the limit is split, on its next bit, until every shard fits. Splits are
decided on sums: bytes are pre-aggregated per cell of leading bits, some sixteen cells to a shard,
and the sums of all shorter prefixes rolled up from those. Rows of a cell that is too large itself
go through another round with more bits. A code has 32 bits of the row's content and 28 of its
number among the rows of that content, lowest bit first, so copies of one row split evenly too, up
to 2^28 shards of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, fresh
from chronoloom.operators.lookup import lookup_join

LIMIT_BYTES = 4 << 20
CONTENT_BITS, PLACE_BITS = 32, 28
BITS = CONTENT_BITS + PLACE_BITS
MORE_BITS = 8


def _prefix(depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftrightunsigned", F.col("code"), F.lit(BITS) - depth)


def _coded(docs: DataFrame, kept: Column, doc_id: str, text: str, limit: int) -> DataFrame:
    """(kept, n_bytes, code), written: the code is a row's content and, where the rows of one
    content exceed the limit, its number among them."""
    rows = cut(
        docs.select(
            kept.alias("kept"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - CONTENT_BITS).alias("content"),
            F.spark_partition_id().alias("part"),
        )
    )
    crowded = cut(
        rows.groupBy(F.col("content").alias("of_content"))
        .agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .filter((F.col("bytes") > limit) & (F.col("rows") > 1))
        .select("of_content", F.lit(True).alias("crowded"))
    )
    alone = F.shiftleft("content", PLACE_BITS).alias("code")
    if crowded.isEmpty():
        return rows.select("kept", "n_bytes", alone)
    marked = lookup_join(rows, crowded, {"content": "of_content"})
    many = marked.filter(F.col("crowded"))
    # One row per content and partition of the written rows.
    before = Window.partitionBy("in_content").orderBy("in_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        many.groupBy(F.col("content").alias("in_content"), F.col("part").alias("in_part"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "in_content", "in_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
        )
    )
    # No larger than a partition of the written rows.
    nth = F.row_number().over(Window.partitionBy("content", "part").orderBy("n_bytes")) - 1
    number = (F.col("offset") + F.col("nth")).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    place = F.conv(F.reverse(F.lpad(F.bin(number), PLACE_BITS, "0")), 2, 10).cast("long")
    numbered = many.withColumn("nth", nth).join(
        offsets,
        (F.col("content") == F.col("in_content")) & (F.col("part") == F.col("in_part")),
    )
    return cut(
        marked.filter(F.col("crowded").isNull())
        .select("kept", "n_bytes", alone)
        .unionByName(
            numbered.select(
                "kept", "n_bytes", F.shiftleft("content", PLACE_BITS).bitwiseOR(place).alias("code")
            )
        )
    )


def _directory(rows: DataFrame, above: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, bytes, rows) of the shallowest bucket below ``above`` bits that fits,
    for each cell of ``bits`` bits; depth is null for cells that have none."""
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    depths = F.sequence(F.lit(above), F.lit(bits))
    levels = cells.withColumn("depth", F.explode(depths)).withColumn(
        "prefix",
        F.call_function("shiftrightunsigned", F.col("cell"), F.lit(bits) - F.col("depth")),
    )
    fitting = (
        levels.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .filter((F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS))
    )
    bucket = F.min(F.struct("depth", "prefix", fitting["bytes"], fitting["rows"]))
    best = levels.select("cell", "depth", "prefix").join(fitting, ["depth", "prefix"])
    return (
        cells.select("cell")
        .join(best.groupBy("cell").agg(bucket.alias("bucket")), "cell", "left")
        .select("cell", "bucket.*")
    )


def _placed(docs: DataFrame, kept: Column, doc_id: str, text: str, limit: int) -> DataFrame:
    """One row per document: kept, n_bytes, shard, depth, shard_bytes, shard_rows."""
    rows = _coded(docs, kept, doc_id, text, limit)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = math.ceil(math.log2(max(1.0, 16 * total / limit)))
    above, bits, parts = 0, min(BITS, max(1, wanted)), []
    while True:
        found = cut(_directory(rows, above, bits, limit))
        placed = rows.withColumn("cell", _prefix(bits)).join(found, "cell")
        parts.append(placed.filter(F.col("depth").isNotNull()))
        if found.filter(F.col("depth").isNull()).isEmpty():
            break
        rows = cut(placed.filter(F.col("depth").isNull()).select("kept", "n_bytes", "code"))
        above, bits = bits + 1, min(BITS, bits + MORE_BITS)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    label = F.expr("shiftleft(1L, depth)").bitwiseOR(F.col("prefix"))
    return whole.select(
        "kept",
        "n_bytes",
        label.alias("shard"),
        "depth",
        F.col("bytes").alias("shard_bytes"),
        F.col("rows").alias("shard_rows"),
    )


def sharded(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``shard``, ``depth``, ``shard_bytes``, ``shard_rows``.

    ``shard`` is the bucket's bits with a one before them, ``n_bytes`` the text's UTF-8 length. No
    shard exceeds ``limit`` bytes unless it is a single document that does (or one content has more
    than 2^28 rows). Shards follow from ids and texts, however the table is partitioned; which of
    several rows equal in both goes to which of their shards is left open. Defined cases: a null
    text has no bytes; a null id, repeated rows and equal ids are documents of their own; other
    columns are ignored; an empty table gives an empty table; one bucket of depth 0 where all fits.
    """
    return _placed(docs, F.col(doc_id), doc_id, text, limit).withColumnRenamed("kept", "doc_id")


def sharded_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES,
    shard: str = "shard",
) -> DataFrame:
    """``docs`` with all its columns and the shard of each row, as :func:`sharded` deals them, to
    be written by ``partitionBy(shard)``. Where ``docs`` has a column of the shard's name already,
    the new one is called ``_shard`` (with a number, if that is taken too)."""
    if shard.lower() in {c.lower() for c in docs.columns}:
        (shard,) = fresh(docs, shard)
    everything = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    placed = _placed(docs, everything, doc_id, text, limit)
    return placed.select("kept.*", F.col("shard").alias(shard))
