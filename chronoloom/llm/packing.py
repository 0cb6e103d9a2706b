"""Packing documents into sequences by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into the other,
drops the bins they duplicate and puts the displaced pieces back by best fit. The pieces are dealt
evenly into districts of a few thousand; every district is searched by several islands in tasks of
their own, their elites migrate into one population that is searched on, and the pieces of badly
filled bins of all districts are pooled and searched again. A task holds one district, whatever
the size of the corpus.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut

CAPACITY, END_ID = 1024, 2
DISTRICT, ISLANDS = 4096, 2
POPULATION, CHILDREN = 5, 24
# A bin filled less than this is opened again when districts are pooled.
WELL_FILLED = 0.97
SEED = 7

PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def encoder(path: str, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text by the vocabulary at ``path``, as tokenizers gives them for the ``.json`` file
    with add_special_tokens=False: the strings of its special tokens become those tokens.

    A ``.json`` file is read by tokenizers, a ``.tiktoken`` file of the same vocabulary by tiktoken
    with its word pattern and the special tokens of the ``.json`` file beside it, which gives the
    same ids in a fifth of the time.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(path)
        return lambda text: np.array(tokens.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    ranks = {a: b for a, b in ranks.items() if b not in set(special.values())}
    model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): only more than ``capacity`` ids are cut, the odd piece first."""
    raw, size = ids.tobytes(), len(ids)
    end = size if size <= capacity else size % capacity or capacity
    start = piece = 0
    while start < size:
        yield piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])
        start, end, piece = end, end + capacity, piece + 1


def _cutter(path: str, pattern: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        last = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), last])
                for piece in pieces_of(ids, capacity):
                    rows.append(i)
                    found.append(piece)
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())),
                    pa.array(columns[0], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[1:]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class Bins:
    """Open bins found by what they have left; ``place`` is best fit in constant time."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[int] = []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, left: int) -> int:
        number = len(self.left)
        self.left.append(left)
        self._open(number, left)
        return number

    def _open(self, number: int, left: int) -> None:
        if left:
            self.by_left[left].append(number)
            self.mask |= 1 << left

    def place(self, size: int) -> int:
        fitting = self.mask >> size
        if not fitting:
            return self.add(self.capacity - size)
        left = size + (fitting & -fitting).bit_length() - 1
        stack = self.by_left[left]
        number = stack.pop()
        if not stack:
            self.mask ^= 1 << left
        self.left[number] = left - size
        self._open(number, left - size)
        return number


def _renumbered(assigned: np.ndarray) -> np.ndarray:
    return np.unique(assigned, return_inverse=True)[1]


def best_fit(sizes: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    bins, assigned = Bins(capacity), np.empty(len(sizes), dtype=np.int64)
    for i in order.tolist():
        assigned[i] = bins.place(int(sizes[i]))
    return assigned


def crossed(
    one: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, chance: random.Random
) -> np.ndarray:
    """A child of ``one`` with whole bins of ``other``, the better filled the likelier."""
    fill = np.bincount(other, weights=sizes) / capacity
    draw = np.array([chance.random() for _ in range(len(fill))])
    injected_bins = draw < 0.5 * fill**8
    injected = injected_bins[other]
    hit = np.zeros(int(one.max()) + 1, dtype=bool)
    hit[one[injected]] = True
    child = np.where(injected, other + len(hit), one)
    displaced = np.flatnonzero(hit[one] & ~injected)
    kept = np.ones(len(one), dtype=bool)
    kept[displaced] = False
    child[kept] = _renumbered(child[kept])
    bins = Bins(capacity)
    used = np.bincount(child[kept], weights=sizes[kept]) if kept.any() else np.zeros(0)
    for load in used.astype(np.int64).tolist():
        bins.add(capacity - load)
    for i in displaced[np.argsort(-sizes[displaced], kind="stable")].tolist():
        child[i] = bins.place(int(sizes[i]))
    return child


def cost(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones."""
    fill = np.bincount(assigned, weights=sizes) / capacity
    return len(fill), -float((fill**2).sum())


def evolved(
    sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], children: int = CHILDREN
) -> np.ndarray:
    """The best solution found from best-fit starts and the elites given."""
    chance = random.Random(seed)
    people = [_renumbered(e) for e in elites]
    noise = 0.0
    while len(people) < POPULATION:
        jitter = np.array([chance.uniform(1 - noise, 1 + noise) for _ in range(len(sizes))])
        people.append(best_fit(sizes, capacity, np.argsort(-sizes * jitter, kind="stable")))
        noise += 0.04
    ranked = sorted(((cost(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    least = -(-int(sizes.sum()) // capacity)
    for number in range(children):
        if ranked[0][0][0] <= least:
            break
        a, b = sorted(chance.sample(range(len(ranked)), 2))
        child = crossed(ranked[a][2], ranked[b][2], sizes, capacity, chance)
        value = cost(child, sizes, capacity)
        if value < ranked[-1][0] and all(value != r[0] for r in ranked):
            ranked[-1] = (value, len(people) + number, child)
            ranked.sort(key=lambda x: x[:2])
    return ranked[0][2]


def _island(capacity: int, seed: int):
    """Searches one district of one island; the elite is its ``bin`` column."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes = table.column("length").to_numpy()
        start = seed * 1_000_003 + int(table.column("district")[0].as_py()) * 31
        found = evolved(sizes, capacity, start + int(table.column("island")[0].as_py()), [])
        return table.append_column("bin", pa.array(found, pa.int64()))

    return run


def _meeting(capacity: int, seed: int):
    """Searches on from the elites of all islands of a district."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("island", "ascending"), ("row", "ascending")])
        island = table.column("island").to_numpy()
        elites = [table.column("bin").to_numpy()[island == i] for i in np.unique(island)]
        own = table.filter(pa.array(island == island[0]))
        sizes = own.column("length").to_numpy()
        start = seed * 1_000_003 + int(own.column("district")[0].as_py())
        found = evolved(sizes, capacity, start, elites)
        order = np.argsort(found, kind="stable")
        own, found, sizes = own.take(pa.array(order)), found[order], sizes[order]
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(found, found)
        used = np.bincount(found, weights=sizes)[found].astype(np.int64)
        return pa.table(
            {
                **{n: own.column(n) for n in ("row", "length", "district")},
                "bin": pa.array(found, pa.int64()),
                "offset": pa.array(before - before[first], pa.int64()),
                "used": pa.array(used, pa.int64()),
            }
        )

    return run


def _searched(small: DataFrame, rows: int, capacity: int, seed: int) -> DataFrame:
    """(row, length, district, bin, offset, used) for the pieces (row, length)."""
    districts = max(1, -(-rows // DISTRICT))
    dealt = small.select("row", "length").withColumns(
        {
            "district": F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(districts)),
            "island": F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))),
        }
    )
    columns = "row long, length long, district long"
    islands = dealt.groupBy("district", "island").applyInArrow(
        _island(capacity, seed), f"{columns}, island int, bin long"
    )
    return islands.groupBy("district").applyInArrow(
        _meeting(capacity, seed), f"{columns}, bin long, offset long, used long"
    )


def packed(
    docs: DataFrame,
    path: str,
    *,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    seed: int = SEED,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` and ``pattern`` name the vocabulary, see :func:`encoder`. A document's ids and
    ``end_id`` are one piece unless they are more than ``capacity``. Defined cases: a null text
    packs like the empty one, as its end id alone; a null id, repeated rows and equal ids are
    documents of their own; other columns are ignored; an empty table gives an empty table.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    pieces = cut(
        read.mapInArrow(_cutter(path, pattern, capacity, end_id), PIECE.format(kind=kind)).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    full = F.col("length") == capacity
    small = pieces.filter(~full)
    first = cut(_searched(small, small.count(), capacity, seed))
    loose = F.col("used") < F.lit(int(WELL_FILLED * capacity))
    again = first.filter(loose)
    second = _searched(again, again.count(), capacity, seed + 1)
    # Sequence numbers: the round, the district and the bin; a full piece has its row's.
    number = F.shiftleft("district", 24) + F.col("bin")
    placed = (
        first.filter(~loose)
        .select("row", number.alias("sequence_id"), "offset")
        .union(second.select("row", (number + F.lit(1 << 60)).alias("sequence_id"), "offset"))
    )
    alone = pieces.filter(full).select(
        "*", (F.col("row") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return small.join(placed, "row").select(alone.columns).union(alone).drop("row")
