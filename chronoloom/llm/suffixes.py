"""Exact repeats of long byte strings by a distributed merge sort of suffixes.

Every string of ``length`` bytes is found from one suffix inside it: the one that starts at the
string's anchor, its position of least hash over short grams, which depends on nothing but the
string. So only anchors are sorted, some one in thirty bytes, and of them only those whose gram
occurs again anywhere (counted first, over all documents).

Documents are dealt into runs. A run sorts its suffixes, settles what repeats within it, and sends
the rest as front-coded slices (common prefix with the one before, then the tail) to the ranges of
the suffix order. There the sorted slices are merged by a loser tree that keeps every contender's
common prefix with the last winner and compares from there on, so known prefixes are never read
again. Suffixes have their gram's hash as a first symbol, which makes ranges even without sampling.

The merged order settles what repeats: strings that start ``d`` bytes before their suffixes agree
behind the anchor where all common prefixes between them reach ``length - d``, which the merge has
found, and before it where the same holds in the order of the reversed bytes there. No string is
looked up or compared again.

No group grows with its copies: a run sends one suffix for each different context. Grams that occur
FREQUENT times are split by the place of the string and a hash of the bytes that all strings of BLOCK
places share; from CROWDED times on, each string is a group of its own, of which a run sends one. So
a group holds fewer than CROWDED contexts or one per run, also around a line of any length that very
many documents have amid different texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import shuffle_partitions

LENGTH = 100
# Occurrences from which a gram's strings are split by place, and places taken together then.
FREQUENT, BLOCK = 64, 8
# Occurrences from which each string is a group of its own.
CROWDED = 1 << 15
# Items that are settled together.
BATCH = 1 << 15
RUNS_PER_PARTITION = 2
LAST = (1 << 63) - 1

_CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_WORD = (1 << 64) - 1


def gram_size(length: int) -> int:
    """The largest power of two up to a third of the length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = _mixed(data.astype(np.uint64) + np.uint64(1))
    factor, step = _BASE, 1
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor & _WORD, step * 2
    return _mixed(h)


class Texts:
    """The documents of one run in order of (id, text), as one array of bytes."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").cast(pa.int64()).fill_null(LAST)
        texts = table.column("text").fill_null("")
        indices = pa.compute.sort_indices(
            pa.table({"i": ids, "t": texts}), [("i", "ascending"), ("t", "ascending")]
        )
        self.table = table.drop_columns(["text"]).take(indices)
        texts = texts.take(indices).combine_chunks().cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        self.ids = ids.take(indices).to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = (
            np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
            if raw is not None and len(offsets)
            else np.zeros(0, dtype=np.uint8)
        )
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0]

    def anchors(self, length: int) -> tuple[np.ndarray, ...]:
        """(position, key, least, most): each anchor with the distances to the starts of the
        strings it stands for."""
        gram = gram_size(length)
        window = length - gram + 1
        found: list[tuple[np.ndarray, ...]] = []
        for begin in range(0, len(self.data) - length + 1, _CHUNK):
            end = min(begin + _CHUNK, len(self.data) - length + 1)
            h = _gram_hashes(self.data[begin : end + length - 1], gram)
            v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            step = 1
            while step * 2 <= window:
                v = np.minimum(v[:-step], v[step:])
                step *= 2
            if window > step:
                v = np.minimum(v[: step - window], v[window - step :])
            place = np.arange(begin, end)
            own = np.searchsorted(self.ends, place, side="right")
            start = np.flatnonzero(place <= self.ends[own] - length)
            if not len(start):
                continue
            at = (v[start] & _LOW).astype(np.int64)
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
            last = np.r_[first[1:] - 1, len(at) - 1]
            p = at[first]
            found.append(
                (p + begin, _mixed(h[p] + _ODD), p - start[last], p - start[first])
            )
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(c) for c in zip(*found))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _squeezed(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    head = struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def _unsqueezed(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, parts = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", raw, 8):
        parts.append(raw[at : at + size])
        at += size
    return parts


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_COUNTS = pa.schema([("range", pa.int32()), ("run", pa.int32()), ("blob", pa.binary())])
_REPEATED = pa.schema([("run", pa.int32()), ("blob", pa.binary())])
_SLICES = pa.schema(
    [("range", pa.int32()), ("run", pa.int32()), ("local", pa.bool_()), ("blob", pa.binary())]
)


def _counter(length: int, ranges: int):
    """Keys of a run with their counts, cut into ranges of keys."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("run")[0].as_py()
        keys, counts = np.unique(Texts(table).anchors(length)[1], return_counts=True)
        place = _range_of(keys, ranges)
        edges = np.searchsorted(place, np.arange(ranges + 1))
        return _rows(
            _COUNTS,
            [
                (r, number, _squeezed(np.diff(keys[a:b], prepend=np.uint64(0)), counts[a:b].astype("<u4")))
                for r, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
                if b > a
            ],
        )

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """For each run, its keys that occur at least twice in all; 1 for frequent, 2 for crowded."""
    runs = table.column("run").to_pylist()
    keys, counts = [], []
    for blob in table.column("blob"):
        a, b = _unsqueezed(blob.as_py())
        keys.append(np.cumsum(np.frombuffer(a, dtype="<u8"), dtype=np.uint64))
        counts.append(np.frombuffer(b, dtype="<u4"))
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every))
    rows, at = [], 0
    for number, own in zip(runs, keys):
        mine = total[inverse[at : at + len(own)]]
        at += len(own)
        again = mine >= 2
        if again.any():
            often = (mine[again] >= FREQUENT).astype("u1") + (mine[again] >= CROWDED).astype("u1")
            rows.append((number, _squeezed(own[again], often)))
    return _rows(_REPEATED, rows)


def _classes(same: np.ndarray, reach: int) -> np.ndarray:
    """Numbers that items of one order share if all common prefixes between them reach so far."""
    return np.cumsum(same < reach)


def _prefixes(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before, -1 where another group begins."""
    same = np.full(len(rows), -1, dtype=np.int64)
    if len(rows) > 1 and rows.shape[1]:
        equal = rows[1:] == rows[:-1]
        same[1:] = np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))
    elif len(rows) > 1:
        same[1:] = 0
    same[1:][group[1:] != group[:-1]] = -1
    return same


def covered(
    same: np.ndarray, rank: np.ndarray, least: np.ndarray, most: np.ndarray,
    befores: list[bytes], length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(item, distance) of each string that an item of lower rank has too.

    Items come in suffix order; ``same`` is the common prefix of each with the one before, -1 where
    a group begins. The strings of an item start ``least`` to ``most`` bytes before its suffix,
    ``befores`` holds the ``most`` bytes there.
    """
    nothing = np.zeros(0, dtype=np.int64)
    if len(same) < 2:
        return nothing, nothing
    # A string of an item reaches at least length - most bytes into its suffix.
    near = np.maximum(same, np.r_[same[1:], -1])
    kept = np.flatnonzero(near >= length - most)
    if len(kept) < 2:
        return nothing, nothing
    # Over items left out, the least of the prefixes between.
    same = np.minimum.reduceat(same[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
    rank, least, most = rank[kept], least[kept], most[kept]
    group = np.cumsum(same < 0)
    width = max(1, int(most.max()))
    back = b"".join(befores[i][::-1].ljust(width, b"\0") for i in kept.tolist())
    backward = np.lexsort((np.frombuffer(back, dtype=f"S{width}"), group))
    bytes_ = np.frombuffer(back, dtype=np.uint8).reshape(-1, width)
    before = _prefixes(bytes_[backward], group[backward])
    items, distances = [], []
    behind = np.empty(len(kept), dtype=np.int64)
    for d in range(int(least.min()), int(most.max()) + 1):
        at = np.flatnonzero((least <= d) & (d <= most))
        if len(at) < 2:
            continue
        behind[backward] = _classes(before, d)
        kind = _classes(same, length - d)[at] * (len(kept) + 1) + behind[at]
        order = np.lexsort((rank[at], kind))
        again = order[1:][kind[order[1:]] == kind[order[:-1]]]
        items.append(kept[at[again]])
        distances.append(np.full(len(again), d))
    if not items:
        return nothing, nothing
    return np.concatenate(items), np.concatenate(distances)


def _batches(opens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BATCH items that cut no group."""
    edges = np.flatnonzero(opens)
    begin = 0
    while begin < len(opens):
        after = np.searchsorted(edges, begin + BATCH)
        end = int(edges[after]) if after < len(edges) else len(opens)
        yield begin, end
        begin = end


def _span_blob(starts: np.ndarray, length: int) -> bytes:
    """The byte ranges that strings from these starts cover."""
    starts = np.unique(starts)
    first = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    begin, last = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
    return _squeezed(
        np.diff(begin, prepend=0).astype("<i8"), (last + length - begin).astype("<i8")
    )


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes are equal."""
    size = min(len(a), len(b))
    x = int.from_bytes(a[known:size], "big") ^ int.from_bytes(b[known:size], "big")
    return size - (x.bit_length() + 7) // 8


def _sorted_suffixes(
    data: bytes, key: np.ndarray, position: np.ndarray, least: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, opens, same) of items sorted by key: their order by (key, suffix), where keys begin
    in it, and the common prefix of each suffix with the one before (-1 where a key begins)."""
    opens = np.r_[True, key[1:] != key[:-1]][: len(key)]
    order = np.arange(len(key))
    same = np.full(len(key), -1, dtype=np.int16)
    for begin, end in _batches(opens):
        where = position[begin:end].tolist()
        ends = (position[begin:end] + length - least[begin:end]).tolist()
        edges = np.flatnonzero(opens[begin:end]).tolist()
        for a, b in zip(edges, [*edges[1:], end - begin]):
            if b == a + 1:
                continue
            own = sorted((data[where[i] : ends[i]], i) for i in range(a, b))
            order[begin + a : begin + b] = [begin + i for _, i in own]
            same[begin + a + 1 : begin + b] = [
                common_prefix(x, y, 0) for (x, _), (y, _) in zip(own, own[1:])
            ]
    return order, opens, same


def _befores(data: bytes, position: np.ndarray, most: np.ndarray) -> list[bytes]:
    """The ``most`` bytes before each position."""
    return [data[a:b] for a, b in zip((position - most).tolist(), position.tolist())]


def _sender(length: int, ranges: int):
    """Sorts a run's suffixes, settles repeats inside it, and front-codes what others may share."""

    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows or not repeated.num_rows:
            return _rows(_SLICES, [])
        number = table.column("run")[0].as_py()
        blobs = [_unsqueezed(b.as_py()) for b in repeated.column("blob")]
        known = np.concatenate([np.frombuffer(a, dtype="<u8") for a, _ in blobs])
        often = np.concatenate([np.frombuffer(b, dtype="u1") for _, b in blobs])
        order = np.argsort(known)
        known, often = known[order], often[order]
        texts = Texts(table)
        position, key, least, most = texts.anchors(length)
        slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        kept = known[slot] == key
        position, key = position[kept], key[kept]
        # Distances are under 256.
        least, most = least[kept].astype(np.int16), most[kept].astype(np.int16)
        together = min(BLOCK, length)
        block = np.array([length + 1, together, 1], dtype=np.int16)[often[slot[kept]]]
        first, last = least // block, most // block
        times = last - first + 1
        position, key, least, most, block, first = (
            np.repeat(x, times) for x in (position, key, least, most, block, first)
        )
        place = first + (np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int16)
        shift = place * block
        position = position - shift
        least = np.maximum(least - shift, 0)
        most = np.minimum(most - shift, block - 1)
        data = texts.data.tobytes()
        split = np.flatnonzero(block <= together)
        if len(split):
            # What all strings of the block share lies from the shifted position on.
            for a in range(0, len(split), BATCH):
                some = split[a : a + BATCH]
                ends = position[some] + length - block[some] + 1
                shared = [
                    xxhash.xxh64_intdigest(data[x:y])
                    for x, y in zip(position[some].tolist(), ends.tolist())
                ]
                key[some] = _mixed(
                    np.array(shared, dtype=np.uint64) + (place[some] + 1).astype(np.uint64) * _ODD
                )
        by_key = np.argsort(key, kind="stable")
        key, position, least, most = (x[by_key] for x in (key, position, least, most))
        order, opens, same = _sorted_suffixes(data, key, position, least, length)
        key, position, least, most = (x[order] for x in (key, position, least, most))
        local: list[np.ndarray] = []
        left = most - least + 1
        for a, b in _batches(opens):
            befores = _befores(data, position[a:b], most[a:b])
            # In a run, documents lie in their order.
            item, back = covered(
                same[a:b], position[a:b] * (length + 1) + most[a:b],
                least[a:b], most[a:b], befores, length,
            )
            local.append(position[a + item] - back)
            np.subtract.at(left, a + item, 1)
        index = np.flatnonzero(left > 0)
        ids = texts.ids[np.minimum(np.searchsorted(texts.ends, position, side="right"), len(texts.ids) - 1)]
        rows = []
        if any(map(len, local)):
            blob = _span_blob(np.concatenate(local), length)
            rows.append((number % ranges, number, True, blob))
        slices = _range_of(key[index], ranges)
        cuts = np.searchsorted(slices, np.arange(ranges + 1)).tolist()
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b == a:
                continue
            prefixes, tails = bytearray(), []
            previous = b""
            previous_key = -1
            chosen = index[a:b]
            ends = position[chosen] + length - least[chosen]
            for x, y, k in zip(position[chosen].tolist(), ends.tolist(), key[chosen].tolist()):
                suffix = data[x:y]
                same = common_prefix(previous, suffix, 0) if k == previous_key else 0
                prefixes.append(same)
                tails.append(suffix[same:])
                previous, previous_key = suffix, k
            rows.append(
                (
                    r,
                    number,
                    False,
                    _squeezed(
                        np.diff(key[chosen], prepend=np.uint64(0)),
                        ids[chosen].astype("<i8"),
                        position[chosen].astype("<i8"),
                        least[chosen].astype("u1"),
                        most[chosen].astype("u1"),
                        bytes(prefixes),
                        b"".join(tails),
                        b"".join(_befores(data, position[chosen], most[chosen])),
                    ),
                )
            )
        return _rows(_SLICES, rows)

    return run


class Slice:
    """A sorted, front-coded slice read item by item: the key as first symbol, then the suffix."""

    def __init__(self, number: int, blob: bytes, length: int):
        keys, ids, positions, least, most, prefixes, self.tails, self.befores = _unsqueezed(blob)
        self.run, self.length = number, length
        # Views give whole numbers of Python, and take 8 bytes for each.
        self.keys = memoryview(np.cumsum(np.frombuffer(keys, dtype="<u8"), dtype=np.uint64))
        self.ids = memoryview(np.frombuffer(ids, dtype="<i8"))
        self.positions = memoryview(np.frombuffer(positions, dtype="<i8"))
        self.least, self.most, self.prefixes = least, most, prefixes
        self.at, self.tail_at, self.before_at, self.suffix = -1, 0, 0, b""

    def advance(self) -> tuple[bytes, int] | None:
        """The next string and its common prefix with the one before; None at the end."""
        self.at += 1
        i = self.at
        if i == len(self.keys):
            return None
        same = self.prefixes[i]
        size = self.length - self.least[i] - same
        self.suffix = self.suffix[:same] + self.tails[self.tail_at : self.tail_at + size]
        self.tail_at += size
        self.before = self.befores[self.before_at : self.before_at + self.most[i]]
        self.before_at += self.most[i]
        head = self.keys[i].to_bytes(8, "big")
        if same or (i and self.keys[i] == self.keys[i - 1]):
            known = 8 + same
        else:
            known = common_prefix(head, self.keys[i - 1].to_bytes(8, "big"), 0) if i else 0
        return head + self.suffix, known

    def item(self) -> tuple:
        """(id, run, position, least, most, bytes before) of the current suffix."""
        i = self.at
        return self.ids[i], self.run, self.positions[i], self.least[i], self.most[i], self.before


def merged(slices: list[Slice]) -> Iterator[tuple[int, tuple]]:
    """Items of all slices in suffix order, each with its common prefix with the one before.

    The tree's inner nodes hold losers. A contender whose known prefix with the last winner is
    longer comes first without a look at its bytes; equal ones are compared from there on.
    """
    size = 1
    while size < len(slices):
        size *= 2
    strings: list[bytes | None] = [None] * size
    known = [0] * size
    for i, s in enumerate(slices):
        step = s.advance()
        if step:
            strings[i] = step[0]
    losers = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the one that does not learns its prefix with the other."""
        x, y = strings[a], strings[b]
        if x is None:
            return False
        if y is None or known[a] > known[b]:
            return True
        if known[a] < known[b]:
            return False
        same = common_prefix(x, y, known[a])
        first = x[same:] < y[same:] or (x[same:] == y[same:] and a < b)
        known[b if first else a] = same
        return first

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1] if size > 1 else 0
    while strings[winner] is not None:
        yield known[winner], slices[winner].item()
        step = slices[winner].advance()
        strings[winner], known[winner] = step if step else (None, 0)
        node = (winner + size) >> 1
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node >>= 1


def _merger(length: int):
    """Merges the slices of one range and settles repeats between runs."""

    def run(table: pa.Table) -> pa.Table:
        slices, rows = [], []
        for number, local, blob in zip(*(table.column(c).to_pylist() for c in ("run", "local", "blob"))):
            if local:
                rows.append((number, blob))
            else:
                slices.append((number, blob))
        starts: dict[int, list[np.ndarray]] = {}
        items: list[tuple] = []
        prefixes: list[int] = []

        def settle() -> None:
            ids, runs, positions, least, most = (
                np.array(x, dtype=np.int64) for x in list(zip(*items))[:5]
            )
            rank = np.empty(len(items), dtype=np.int64)
            rank[np.lexsort((most, positions, runs, ids))] = np.arange(len(items))
            item, back = covered(
                np.array(prefixes, dtype=np.int64), rank, least, most, [i[5] for i in items], length
            )
            found, number = positions[item] - back, runs[item]
            for n in np.unique(number).tolist():
                starts.setdefault(n, []).append(found[number == n])

        for known, item in merged([Slice(n, b, length) for n, b in sorted(slices)]):
            if known < 8 and len(items) >= BATCH:
                settle()
                items, prefixes = [], []
            # The first symbol's 8 bytes are the key.
            prefixes.append(known - 8 if known >= 8 and items else -1)
            items.append(item)
        if items:
            settle()
        rows.extend(
            (number, _span_blob(np.concatenate(found), length)) for number, found in starts.items()
        )
        return _rows(_REPEATED, rows)

    return run


def _marked(covered: pa.Table, size: int) -> np.ndarray:
    """Whether each of ``size`` bytes lies in a range of any blob."""
    begins, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for blob in covered.column("blob"):
        starts, sizes = (np.frombuffer(x, dtype="<i8") for x in _unsqueezed(blob.as_py()))
        begins.append(np.cumsum(starts))
        ends.append(begins[-1] + sizes)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin)
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    opens = np.r_[True, begin[1:] > reach[:-1]][: len(begin)]
    # Ranges that neither overlap nor touch, so the sums are 0 or 1.
    change = np.zeros(size + 1, dtype=np.int8)
    change[begin[opens]] = 1
    change[reach[np.r_[opens[1:], True][: len(reach)]]] = -1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _cutter(schema: pa.Schema, with_text: bool):
    """Takes the covered bytes out of a run's documents."""

    def run(table: pa.Table, covered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        texts = Texts(table)
        gone = _marked(covered, len(texts.data))
        rows = []
        for a, b in zip(texts.starts.tolist(), texts.ends.tolist()):
            own, bytes_ = gone[a:b], texts.data[a:b]
            removed = int(own.sum())
            runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            left = (bytes_[~own] if removed else bytes_).tobytes()
            text = left.decode("utf-8", "ignore") if with_text else None
            rows.append((b - a, removed, runs, hashlib.sha256(left).hexdigest(), text))
        columns = list(zip(*rows))
        arrays = [texts.table.column("doc_id"), texts.table.column("rest")]
        arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:])]
        return pa.table(arrays, schema=schema)

    return run


def repeats_removed(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, ``rest`` (a struct of its other columns), n_bytes, n_removed,
    n_spans, kept_sha256 and, if wanted, the kept ``text``.

    A byte is removed when a string of ``length`` bytes that covers it also starts earlier, in a
    smaller id or earlier in the same document. Ids are whole numbers. Defined cases: a null text
    is empty; null ids come last; rows of one id follow each other in order of their texts; texts
    shorter than ``length`` stay whole; an empty table gives an empty table; in the text, what is
    left of a character that lost bytes goes too.
    """
    if not 3 <= length <= 255:
        raise ValueError("length must be from 3 to 255")
    partitions = shuffle_partitions(docs.sparkSession)
    runs = partitions * RUNS_PER_PARTITION
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(runs)).cast("int").alias("run"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.struct(*others, F.lit(0).alias("_")).alias("rest"),
    ).repartition(partitions, "run")
    counts = dealt.groupBy("run").applyInArrow(
        _counter(length, runs), "range int, run int, blob binary"
    )
    repeated = counts.groupBy("range").applyInArrow(_repeats, "run int, blob binary")
    slices = (
        dealt.groupBy("run")
        .cogroup(repeated.groupBy("run"))
        .applyInArrow(_sender(length, runs), "range int, run int, local boolean, blob binary")
    )
    covered = slices.groupBy("range").applyInArrow(_merger(length), "run int, blob binary")
    kinds = dealt.schema
    out = (
        f"doc_id {kinds['doc_id'].dataType.simpleString()}, "
        f"rest {kinds['rest'].dataType.simpleString()}, "
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return (
        dealt.groupBy("run")
        .cogroup(covered.groupBy("run"))
        .applyInArrow(_cutter(schema, with_text), out)
    )


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeats taken out of the text and its other columns as they were."""
    found = repeats_removed(docs, doc_id=doc_id, text=text, length=length)
    return found.select(
        *(
            F.col(c).alias(docs_name)
            if c in ("doc_id", "text")
            else F.col("rest").getField(docs_name).alias(docs_name)
            for docs_name in docs.columns
            for c in ["doc_id" if docs_name == doc_id else "text" if docs_name == text else "rest"]
        )
    )
