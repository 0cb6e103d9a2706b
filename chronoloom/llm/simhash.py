"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most r bits share a point that differs from each in at
most r/2 bits. Every distinct fingerprint emits all points of that small ball (65 for radius 2),
equal points meet in a shuffle, and each pair of neighbours there is verified and kept once. A
point is shared by at most 65 distinct fingerprints, so no group can be large however many copies
the corpus holds; copies themselves collapse before, into one row per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, fresh
from chronoloom.llm.components import connected

SEED, SHINGLE, RADIUS = 42, 3, 2
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TABLE = bytes(_SPACES[_LOWER[b]] for b in range(256))
# Hashes whose bits are counted at a time: bounds the memory a very long text takes.
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits: each is 1 where more than half of the shingles' hashes have it; signed as a LONG."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not found:
        return 0
    if len(found) < SHINGLE:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(found, found[1:], found[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    value = int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >= 1 << 63 else value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "bits"])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits) of every row, as many rows as ``docs``."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_fingerprints, f"doc_id {kind}, bits long")


def _ball(bits: Column, radius: int) -> Column:
    """All points that differ from ``bits`` in at most ``radius`` bits, as an array."""
    if radius < 0 or radius > 2:
        raise ValueError("balls are enumerated up to radius 2")
    points = F.array(bits)
    flip = lambda x, i: x.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i))
    if radius >= 1:
        points = F.concat(points, *(F.array(flip(bits, i)) for i in range(64)))
    if radius == 2:
        points = F.concat(
            points,
            *(F.array(flip(flip(bits, i), j)) for i in range(64) for j in range(i + 1, 64)),
        )
    return points


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs ``a < b`` of distinct fingerprints, enough of them to join all that link.

    Fingerprints around one point form a chain in order of value instead of all pairs. For an even
    radius all of them are within it, so the chain joins what the pairs would; the distance of
    each chained pair is still verified.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    distinct = prints.select("bits").distinct()
    around = distinct.select("bits", F.explode(_ball(F.col("bits"), radius // 2)).alias("point"))
    order = F.lag("bits").over(Window.partitionBy("point").orderBy("bits"))
    chained = around.withColumn("before", order).filter(F.col("before").isNotNull())
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("before"))) <= radius
    return chained.filter(near).select(F.col("before").alias("a"), F.col("bits").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: doc_id, ``fingerprint`` as hex, ``component_id``, ``n_copies``.

    ``component_id`` is the smallest id among the documents reachable over links, ``n_copies`` how
    many documents share exactly this fingerprint. Defined cases: null and blank texts have
    fingerprint zero and link like any other; a null id is reached and grouped but never names a
    component unless all its ids are null; repeated rows stay repeated; other columns are ignored;
    an empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, doc_id=doc_id, text=text))
    nodes = prints.groupBy("bits").agg(
        F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n_copies")
    )
    roots = connected(links(prints, radius))
    placed = nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )
    named = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = placed.join(named, "root").select("bits", "component_id", "n_copies")
    return prints.join(classes, "bits").select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_copies",
    )


def one_of_each(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` that are first of their component, with their own columns.

    The row that stays has the component's smallest id (null ids last), of equal ids the smallest
    hash of id and text. Rows are told apart by id and text together, so rows that share an id or
    have none, but differ in their texts, are documents of their own. Rows equal in both are one
    document; the one with the smallest hash of the other columns stays.
    """
    name, kept, order = fresh(docs, "row", "kept", "order")
    own = F.concat_ws(
        "\x00", F.col(doc_id).isNull().cast("string"), F.col(doc_id).cast("string"),
        F.col(text).isNull().cast("string"), F.col(text),
    )
    named = docs.withColumn(name, F.sha2(own, 256))
    row = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(name).alias("key"))
    prints = cut(fingerprints(named.withColumn(kept, row), doc_id=kept, text=text))
    roots = connected(links(prints, radius)).withColumnRenamed("node", "bits")
    # Combined per fingerprint first, so that copies without number are one row.
    firsts = (
        prints.groupBy("bits")
        .agg(F.min("doc_id").alias("first"))
        .join(roots, "bits", "left")
        .groupBy(F.coalesce("root", "bits").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias(kept))
    )
    # Equal rows are cut to one per task before they are shuffled.
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    ties = F.xxhash64(*(rest or [doc_id]))
    one = Window.partitionBy(name).orderBy(ties)
    single = named.withColumn(order, F.row_number().over(one)).filter(F.col(order) == 1)
    return single.join(firsts, F.col(name) == F.col(kept)).select(*docs.columns)
