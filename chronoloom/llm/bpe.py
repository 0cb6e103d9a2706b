"""Byte-level BPE encoding and decoding, with long texts encoded in overlapping chunks.

A text is a sequence of pre-tokens, the matches of the vocabulary's word pattern, and each is
encoded on its own. So a text may be cut wherever a pre-token ends, but where that is depends on
all the text before. Long texts are therefore cut anywhere, into chunks that overlap, and every
chunk is pre-tokenised in a task of its own. A chunk that starts in the middle of a word gets its
first boundaries wrong and then falls into step: where both chunks see a boundary in the text they
share, they agree from there on, as a match depends only on what follows it. The pieces between
such places are encoded, again one by one, and their ids joined in order. Where two chunks do not
fall into step within their overlap (one pre-token fills it), the rest of the text from the last
agreed place on is one piece, so results are whole whatever the text is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut
from chronoloom.operators.lookup import BROADCAST_ROWS, lookup_join

# Characters of a chunk's own part, and of the part it shares with the next chunk.
CHUNK, OVERLAP = 1 << 15, 1 << 11
# Characters after a boundary that a match before it may have looked at.
LOOKAHEAD = 3


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks by a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}


def encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as unsigned 32-bit integers; strings of special tokens are plain text."""
    import tiktoken

    model = tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={}
    )

    def encode(text: str) -> np.ndarray:
        return np.array(model.encode_ordinary(text), dtype="<u4")

    return encode


def boundaries(pattern: str) -> Callable[[str], list[int]]:
    """Where the pre-tokens of a text end, as offsets in characters."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    return lambda text: [end for _, (_, end) in split.pre_tokenize_str(text)]


def _id_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view("<i4"), pa.int32()))


def _encode(path: str, pattern: str, names: list[str]):
    """Encode the last column; the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            ids = [encode(text.as_py() or "") for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _id_lists(ids)], names)

    return run


def _chunks(size: int, overlap: int):
    """(key, number, part) for every chunk of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                count = -(-(len(text) - overlap) // size)
                parts = [text[i * size : (i + 1) * size + overlap] for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * count, pa.string()),
                        pa.array(range(count), pa.int32()),
                        pa.array([i == count - 1 for i in range(count)], pa.bool_()),
                        pa.array(parts, pa.string()),
                    ],
                    ["key", "number", "last", "part"],
                )

    return run


def _bounds(pattern: str, size: int, overlap: int):
    """The boundaries a chunk sees in the part shared with the chunk before it and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = boundaries(pattern)
        for batch in batches:
            heads, tails = [], []
            for number, last, part in zip(*(c.to_pylist() for c in batch.columns[1:])):
                seen = len(part) - (0 if last else LOOKAHEAD)
                ends = np.array(find(part), dtype=np.int64)
                ends = ends[ends <= seen]
                heads.append((ends[ends <= overlap] + number * size).tolist())
                tails.append((ends[ends > size] + number * size).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(heads, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64()))],
                ["key", "number", "head", "tail"],
            )

    return run


def _stitched(chunks: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """(key, piece, part): the texts of the pieces between places where chunks are in step."""
    bounds = chunks.select("key", "number", "last", "part").mapInArrow(
        _bounds(pattern, size, overlap),
        "key string, number int, head array<long>, tail array<long>",
    )
    text, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("number")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    met = F.when(F.col("number") == 0, F.lit(0).cast("long")).otherwise(met)
    # From the first chunk out of step on, all chunks add to the piece before it.
    placed = (
        bounds.select("key", "number", met.alias("met"))
        .withColumn("lost", F.min(F.when(F.col("met").isNull(), F.col("number"))).over(text))
        .withColumn("alone", F.col("lost").isNull() | (F.col("number") < F.col("lost") - 1))
        .withColumn("opens", F.col("lost").isNull() | (F.col("number") < F.col("lost")))
        .withColumn(
            "from", F.when(F.col("opens"), F.col("met")).otherwise(F.col("number") * F.lit(size))
        )
        .select(
            "key", "number", "alone", "from",
            F.lead("from").over(order).alias("to"),
            F.least("number", F.col("lost") - 1).alias("piece"),
        )
    )
    # Written, as both kinds of pieces read it: chunks are pre-tokenised once.
    placed = cut(placed)
    at = F.col("number") * F.lit(size)
    own = F.substring("part", (F.col("from") - at + 1).cast("int"),
                      F.coalesce(F.col("to") - F.col("from"), F.length("part")).cast("int"))
    parts = chunks.join(placed, ["key", "number"]).select(
        "key", "piece", "number", "alone", own.alias("part")
    )
    long = parts.filter(~F.col("alone")).groupBy("key", "piece").agg(
        F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts")
    )
    return parts.filter("alone").select("key", "piece", "part").unionByName(
        long.select("key", "piece", F.concat_ws("", F.col("parts.part")).alias("part"))
    )


def encoded(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids) of every row: its text's ids by the ``.tiktoken`` file ``vocabulary``.

    Texts of more than ``chunk + overlap`` characters are cut into chunks that tasks share; equal
    long texts are encoded once. Defined cases: null and empty texts have no ids (an empty array);
    null and repeated ids stay as they are, one row each; other columns are ignored; an empty
    table gives an empty table. Every text is encoded to its end.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = read.filter(~is_long).mapInArrow(
        _encode(vocabulary, pattern, ["doc_id", "ids"]), f"doc_id {kind}, ids array<int>"
    )
    keyed = read.filter(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    chunks = (
        keyed.select("key", "text")
        .mapInArrow(_chunks(chunk, overlap), "key string, number int, last boolean, part string")
        .dropDuplicates(["key", "number"])
    )
    pieces = _stitched(chunks, pattern, chunk, overlap).mapInArrow(
        _encode(vocabulary, pattern, ["key", "piece", "ids"]),
        "key string, piece int, ids array<int>",
    )
    joined = pieces.groupBy(F.col("key").alias("of")).agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("piece", "ids"))).getField("ids")).alias("ids")
    )
    long = lookup_join(keyed.select("doc_id", "key"), joined, {"key": "of"},
                       right_rows=BROADCAST_ROWS + 1)
    return short.unionByName(long.select("doc_id", "ids"))


def _token_bytes(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        table[number] = token
    return table


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as arrays; null lists are empty."""
    values = np.asarray(column.values, dtype="<i4")
    ends = np.asarray(column.offsets)
    for i in range(len(column)):
        yield values[ends[i] : ends[i + 1]] if column[i].is_valid else values[:0]


def decoded(encodings: DataFrame, vocabulary: str) -> DataFrame:
    """``encodings`` (doc_id, ids) with ``bytes``: the raw bytes of the tokens, one after the other.

    A character may lie across tokens, so bytes are joined before anything reads them as text.
    Null ids are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(vocabulary)
        for batch in batches:
            raw = [b"".join([table[i] for i in ids.tolist()]) for ids in _rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.large_binary()).cast(pa.binary())],
                ["doc_id", "ids", "bytes"],
            )

    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, bytes binary"
    )


def digests(encodings: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids and what they decode to, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(vocabulary)
        for batch in batches:
            found = []
            for ids in _rows(batch.column(1)):
                raw = b"".join([table[i] for i in ids.tolist()])
                found.append((
                    len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                    hashlib.sha256(raw).hexdigest(),
                ))
            counts, of_ids, of_bytes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
