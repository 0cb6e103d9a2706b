"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers cut the same bytes, so tokens are byte ranges without gaps. For a batch of
documents, an as-of merge keyed by document finds for each token's start the other side's token
that covers it; both directions together give all overlaps, since of two ranges that overlap one
starts inside the other. Overlaps that end together are links, and their ends cut the document
into groups. What is counted over the whole corpus, how often an id pair is linked, is counted from
a written table of each document's distinct pairs, so that no text is tokenised twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.bpe import ranks_of
from chronoloom.llm.common import cut, shared_folder
from chronoloom.operators.lookup import lookup_join

# Bytes of text that are merged at a time; a longer text is merged alone.
_BLOCK = 1 << 20
_ROW = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
       "groups string, pairs array<long>, times array<int>"


def _piece_bytes(model) -> list[bytes]:
    """The bytes each piece of a sentencepiece model stands for."""
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(
            bytes([int(piece[3:5], 16)]) if model.is_byte(i)
            else piece.replace("▁", " ").encode()
        )
    return table


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in ``a``, in ``b``) of all tokens that overlap; both hold doc and at (the start
    in the batch), in order."""
    of_a = pd.merge_asof(a, b, on="at", by="doc", suffixes=("_a", "_b"))
    of_b = pd.merge_asof(b, a, on="at", by="doc", suffixes=("_b", "_a"))
    # A pair that starts together is found in both directions.
    starts = a["at"].to_numpy()
    again = starts[of_b["row_a"].to_numpy()] == b["at"].to_numpy()
    return (
        np.concatenate([of_a["row_a"].to_numpy(), of_b["row_a"].to_numpy()[~again]]),
        np.concatenate([of_a["row_b"].to_numpy(), of_b["row_b"].to_numpy()[~again]]),
    )


def _grouped(a_ids, b_ids, a_ends_group, b_ends_group, names) -> np.ndarray:
    """The ids of both sides as strings in the order of groups, each with the mark that follows."""
    a_comma, a_bar, b_comma, b_end = names
    a_before = np.cumsum(a_ends_group) - a_ends_group
    b_before = np.cumsum(b_ends_group) - b_ends_group
    b_starts = np.concatenate([[0], np.cumsum(np.bincount(b_before))])
    a_stops = np.cumsum(np.bincount(a_before))
    text = np.empty(len(a_ids) + len(b_ids), dtype=object)
    text[np.arange(len(a_ids)) + b_starts[a_before]] = np.where(
        a_ends_group, a_bar[a_ids], a_comma[a_ids])
    text[np.arange(len(b_ids)) + a_stops[b_before]] = np.where(
        b_ends_group, b_end[b_ids], b_comma[b_ids])
    return text


class _Aligner:
    """Both tokenizers with their tables, loaded once per task."""

    def __init__(self, byte_vocabulary: str, pattern: str, piece_model: str, groups: bool):
        import sentencepiece
        import tiktoken

        ranks = ranks_of(byte_vocabulary)
        self.bytes_model = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces_model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.piece_bytes = _piece_bytes(self.pieces_model)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.a_sizes[number] = len(token)
        self.b_sizes = np.array([len(x) for x in self.piece_bytes], dtype=np.int64)
        most = max(len(self.a_sizes), len(self.b_sizes))
        self.names = [
            np.array([f"{i}{mark}" for i in range(most)], dtype=object) for mark in ",|,;"
        ]
        self.groups = groups

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """One tuple per text: the counts, hash, groups, pairs and times of ``_ROW``."""
        found: list[tuple] = [(0, 0, 0, 0, "", "" if self.groups else None, [], [])] * len(texts)
        tokens = []
        for i, text in enumerate(texts):
            if not text:
                continue
            b_ids = self.pieces_model.encode(text)
            raw = b"".join([self.piece_bytes[k] for k in b_ids])
            if raw == (" " + text).encode():
                a_ids = self.bytes_model.encode_ordinary(" " + text)
                tokens.append((i, np.array(a_ids, np.int64), np.array(b_ids, np.int64)))
        if tokens:
            self._align(tokens, found)
        return found

    def _align(self, tokens: list[tuple], found: list[tuple]) -> None:
        a_ids, b_ids = (np.concatenate([t[k] for t in tokens]) for k in (1, 2))
        a_stop, b_stop = (np.cumsum([len(t[k]) for t in tokens]) for k in (1, 2))
        docs = np.arange(len(tokens))
        a_doc, b_doc = np.repeat(docs, np.diff(a_stop, prepend=0)), np.repeat(docs, np.diff(b_stop, prepend=0))
        a_end, b_end = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        side = lambda doc, end, ids, sizes, row: pd.DataFrame(
            {"doc": doc, "at": end - sizes[ids], row: np.arange(len(ids))})
        in_a, in_b = overlaps(side(a_doc, a_end, a_ids, self.a_sizes, "row_a"),
                              side(b_doc, b_end, b_ids, self.b_sizes, "row_b"))
        together = a_end[in_a] == b_end[in_b]
        in_a, in_b = in_a[together], in_b[together]
        a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        a_last[in_a], b_last[in_b] = True, True
        n_groups = np.bincount(a_doc[a_last], minlength=len(tokens))
        n_links = np.bincount(a_doc[in_a], minlength=len(tokens))
        marked = _grouped(a_ids, b_ids, a_last, b_last, self.names)
        # Distinct id pairs of each document with the number of its links that hold them.
        n_ids = len(self.b_sizes)
        of_doc = len(self.a_sizes) * n_ids
        held, times = np.unique(
            a_doc[in_a] * of_doc + a_ids[in_a] * n_ids + b_ids[in_b], return_counts=True)
        held_doc, held = np.divmod(held, of_doc)
        pairs = (held // n_ids << 32) | held % n_ids
        stops = np.searchsorted(held_doc, docs, side="right")
        ends, starts = a_stop + b_stop, np.concatenate([[0], (a_stop + b_stop)[:-1]])
        for n, (i, mine_a, mine_b) in enumerate(tokens):
            groups = "".join(marked[starts[n] : ends[n]].tolist())[:-1]
            span = slice(stops[n - 1] if n else 0, stops[n])
            found[i] = (
                len(mine_a), len(mine_b), int(n_groups[n]), int(n_links[n]),
                hashlib.sha256(groups.encode()).hexdigest(), groups if self.groups else None,
                pairs[span], times[span],
            )


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text or "") > _BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text or "")
    if block:
        yield block


def aligned(
    docs: DataFrame,
    byte_vocabulary: str,
    pattern: str,
    piece_model: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    groups: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ``groups``
    (``a1,a2|b1;a3|b2,b3``: the ids of each group's A and B tokens; null if ``groups`` is false)
    and the distinct linked id ``pairs`` (A id times 2^32 plus B id) with their ``times``.

    A's tokens are those of the byte-level ``.tiktoken`` vocabulary for a space and the text, B's
    those of the sentencepiece model for the text. Special tokens' strings are plain text.
    Defined cases: texts that are null or empty, or whose B tokens do not spell the space and the
    text (the text holds U+2581, say), have no tokens, so zeros, empty strings and arrays; null
    and repeated ids stay, one row each; other columns are ignored; an empty table gives an empty
    table. A document's tokens lie in one task; texts are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(byte_vocabulary, pattern, piece_model, groups)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                columns = list(zip(*aligner.rows(block)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(block)),
                        *(pa.array(c, pa.int64()) for c in columns[:4]),
                        *(pa.array(c, pa.string()) for c in columns[4:6]),
                        pa.array(columns[6], pa.list_(pa.int64())),
                        pa.array(columns[7], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups",
                     "pairs", "times"],
                )
                at += len(block)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, _ROW.format(kind=kind)
    )


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked id pair: how many links of the corpus hold it, and whether
    no pair of its B id has more."""
    counts = cut(
        alignments.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
        .groupBy(F.col("link.pairs").alias("pair"))
        .agg(F.sum("link.times").alias("n"))
    )
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # One row per id of the piece model, so as small as that.
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), b_id == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def scored(alignments: DataFrame) -> DataFrame:
    """``alignments`` (as ``aligned`` gives them) with ``n_best``, the links whose pair is most
    frequent of its B id in the corpus, and ``count_sum``, the sum of the links' pair counts.

    Rows are written once and numbered there, so that null and repeated ids stay apart.
    """
    spark = alignments.sparkSession
    folder = f"{shared_folder(spark)}/alignments-{uuid.uuid4().hex}"
    alignments.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    counts = cut(pair_counts(rows)).withColumnRenamed("pair", "of")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    sums = (
        lookup_join(links, counts, {"pair": "of"})
        .groupBy(F.col("row").alias("of_row"))
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    kept = [c for c in alignments.columns if c not in ("pairs", "times")]
    return rows.join(sums, F.col("row") == F.col("of_row"), "left").select(
        *kept, zero("n_best"), zero("count_sum")
    )
