"""Match facts to the version that was valid at their time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.dedup import keep_latest
from chronoloom.operators.lookup import lookup_join

# A place in time: twice the day, and one more after its midnight. Versions begin and end at
# midnights, so all moments of one place have the same best version. A block has 256 days.
BLOCK_BITS = 9
_BLOCK = 1 << BLOCK_BITS


@dataclass(frozen=True)
class Versions:
    """A version table: of several versions that cover a fact the one with the largest ``prefer``
    columns, compared in turn, is the best; ``take`` maps its columns to output names."""

    table: DataFrame
    prefer: Sequence[str]
    take: Mapping[str, str]
    start: str = "start_date"
    end: str = "end_date"

    def checked(self) -> Versions:
        for bound in (self.start, self.end):
            if self.table.schema[bound].dataType.typeName() != "date":
                raise TypeError(f"{bound} must be a date")
        return self

    def spans(self, key: str, blocks: tuple[int, int]) -> DataFrame:
        """One row per version with the places and the blocks it covers, within ``blocks``."""
        first, last = blocks
        best = F.struct(
            *(F.col(c).alias(f"p{i}") for i, c in enumerate(self.prefer)),
            F.struct(*(F.col(c).alias(name) for c, name in self.take.items())).alias("take"),
        )
        covered = self.table.select(
            F.col(key).alias("_span_key"),
            F.greatest(2 * F.unix_date(self.start), F.lit(first * _BLOCK)).alias("from"),
            F.least(2 * F.unix_date(self.end), F.lit(last * _BLOCK + _BLOCK - 1)).alias("until"),
            best.alias("best"),
        )
        # GREATEST and LEAST skip unknowns: bounds that are missing cover nothing.
        known = F.col("_span_key").isNotNull() & F.col(self.start).isNotNull()
        return covered.filter(
            known & F.col(self.end).isNotNull() & (F.col("from") <= F.col("until"))
        )


def interval_match_best(
    facts: DataFrame,
    versions: DataFrame,
    *,
    key: str,
    at: str,
    prefer: Iterable[str],
    take: Mapping[str, str],
    start: str = "start_date",
    end: str = "end_date",
    fact_id: Iterable[str] = (),
    fact_order: Iterable[str] = (),
    sizes_from: DataFrame | None = None,
    times_from: DataFrame | None = None,
) -> DataFrame:
    """Left-join each fact to its best covering version; facts without one keep NULLs.

    A version covers a fact when ``start <= at <= end`` (``start`` and ``end`` are dates). Of
    several, the one with the largest ``prefer`` columns, compared in turn, wins. ``take`` maps
    version columns to output names. With ``fact_id`` the result has one row per id: the one with
    the preferred version, then the first in ``fact_order``. See ``interval_match_all``.
    """
    return interval_match_all(
        facts, [Versions(versions, tuple(prefer), take, start, end)], key=key, at=at,
        fact_id=fact_id, fact_order=fact_order, sizes_from=sizes_from, times_from=times_from,
    )


def interval_match_all(
    facts: DataFrame,
    versions: Sequence[Versions],
    *,
    key: str,
    at: str,
    fact_id: Iterable[str] = (),
    fact_order: Iterable[str] = (),
    sizes_from: DataFrame | None = None,
    times_from: DataFrame | None = None,
) -> DataFrame:
    """Each fact with the best covering version of every table in ``versions``, by one join.

    The versions of a key are swept into segments that do not overlap, each with its best version
    (see ``segments``), and lie as two arrays in one row per key and block of 256 days: a fact
    finds its row by an equality join and its segment by binary search. So the join returns one
    row per fact, there are no pairs to produce and reduce again, and the facts of a busy key
    spread over its blocks. Few rows in all are broadcast; else see ``lookup_join`` for keys with
    very many facts and for ``sizes_from``, a cheaper table that holds the facts' keys (their
    times are taken from it too where it has them). ``times_from`` is a cheaper table that holds all
    their times, for the first and last of them only.

    With ``fact_id`` one row per id stays: the one whose version of the first table is preferred.
    """
    inputs = list(facts.columns)
    where = _place(facts, at)
    timed = facts if times_from is None else times_from
    if times_from is None and sizes_from is not None and at in sizes_from.columns:
        timed = sizes_from
    blocks = _blocks(timed, at)
    tables = [v.checked().spans(key, blocks) for v in versions]
    rows = sum(_pieces(t) for t in tables)
    # The place is worked out on both sides of the join, so that no shuffle carries it.
    matched = lookup_join(
        facts, _together([segments(t) for t in tables]), {key: "_span_key"}, right_rows=rows,
        also=F.shiftright(where, BLOCK_BITS) == F.col("_span_block"), sizes_from=sizes_from,
    ).withColumn("_at", where).withColumns({
        f"_best{n}": F.get(f"_best{n}", _held(F.col(f"_from{n}"), F.col("_at")) - 1)
        for n in range(len(tables))
    })
    fact_id = list(fact_id)
    if fact_id:
        ranked = {f"_p{i}": F.col("_best0")[f"p{i}"] for i in range(len(versions[0].prefer))}
        matched = keep_latest(
            matched.withColumns(ranked), fact_id, [*(f"-{c}" for c in ranked), *fact_order]
        )
    return matched.select(*inputs, *(
        F.col(f"_best{n}.take")[name].alias(name)
        for n, v in enumerate(versions) for name in v.take.values()
    ))


def _place(facts: DataFrame, at: str) -> Column:
    day = F.to_date(at)
    if facts.schema[at].dataType.typeName() == "date":
        return 2 * F.unix_date(day)
    later = F.col(at) > day.cast(facts.schema[at].dataType)
    return 2 * F.unix_date(day) + F.when(later, 1).otherwise(0)


def _blocks(facts: DataFrame, at: str) -> tuple[int, int]:
    """The first and last block that facts fall in: versions without an end need no more."""
    ends = facts.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    low, high = ends.select(
        *(F.shiftright(2 * F.unix_date(F.to_date(c)), BLOCK_BITS) for c in ("low", "high"))
    ).first()
    return (0, -1) if low is None else (low, high)


def _pieces(spans: DataFrame) -> int:
    """How many blocks all versions cover together: a bound of the rows, counted without a
    shuffle."""
    held = F.shiftright("until", BLOCK_BITS) - F.shiftright("from", BLOCK_BITS) + 1
    return spans.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]


def segments(spans: DataFrame) -> DataFrame:
    """(_span_key, _span_block, from, best): the versions of a key as segments that do not overlap.

    ``from`` holds, in order, the places of a block where the set of covering versions changes,
    ``best`` the best of those that cover from there to the next change, NULL for none. Only the
    best version of each distinct span of a block is kept, by an aggregate that combines before the
    shuffle; a block has 256 days, so at most 32,896 spans and 513 changes meet in a row, however
    many versions a key has and however they are nested.
    """
    block = F.col("_span_block")
    cut = spans.withColumn(
        "_span_block",
        F.explode(F.sequence(F.shiftright("from", BLOCK_BITS), F.shiftright("until", BLOCK_BITS))),
    ).groupBy(
        "_span_key",
        "_span_block",
        F.greatest("from", block * _BLOCK).alias("from"),
        F.least("until", block * _BLOCK + _BLOCK - 1).alias("until"),
    ).agg(F.max("best").alias("best"))
    gathered = cut.groupBy("_span_key", "_span_block").agg(
        F.collect_list(F.struct("from", "until", "best")).alias("_spans")
    )
    held = F.col("_spans")
    places = F.concat(held["from"], F.transform(held["until"], lambda u: u + 1))
    covering = lambda c: F.filter(held, lambda s: (s["from"] <= c) & (c <= s["until"]))
    return gathered.withColumn("from", F.array_sort(F.array_distinct(places))).select(
        "_span_key",
        "_span_block",
        "from",
        F.transform("from", lambda c: F.array_max(covering(c)["best"])).alias("best"),
    )


def _together(tables: list[DataFrame]) -> DataFrame:
    """One row per key and block with the segments of every table."""
    keys = ["_span_key", "_span_block"]
    named = [
        t.select(*keys, F.col("from").alias(f"_from{n}"), F.col("best").alias(f"_best{n}"))
        for n, t in enumerate(tables)
    ]
    joined = named[0]
    for table in named[1:]:
        joined = joined.join(table, keys, "full")
    return joined


def _held(starts: Column, place: Column) -> Column:
    """How many of the sorted ``starts`` are not after ``place``, by binary search."""

    def search(bits: int) -> Column:
        return F.aggregate(
            F.array(*(F.lit(1 << i) for i in reversed(range(bits)))),
            F.lit(0),
            lambda found, step: F.when(F.get(starts, found + step - 1) <= place, found + step)
            .otherwise(found),
        )

    # Most blocks hold a few segments: three steps find one of seven.
    return F.when(F.size(starts) < 8, search(3)).otherwise(search(BLOCK_BITS + 1))
