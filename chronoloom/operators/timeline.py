"""Ordered work inside groups that stays distributed when one group is huge.

A window partitioned by an entity puts all rows of that entity into one task. A Timeline first
counts the rows per group. Groups below the limit use ordinary windows: one shuffle on the group
key, shared by every step. A group above it is cut into slices by bounds in its order: a row's
slice is the number of bounds not after it, a pure function of the row. The bounds come from a
sample, which decides how even the slices are and nothing else. A window then runs per (group,
slice); what a slice must know about others is passed along in two small ways:

* bounded look-back or look-ahead: the last (first) rows of a slice are copied to its neighbours
  as halo rows and removed again. Steps that follow each other share one halo, as wide as their
  reaches together;
* running totals and row numbers: one total per slice is accumulated over the slices of the group
  and joined back;
* ranks, and totals that rows with the same time share: worked out on one row per distinct time
  (or value) and looked up, so a value with very many rows is combined first.

Results are the same either way. The limit is ``spark.chronoloom.hotRows`` rows per group. A series
without a key is one group that would leave all other tasks idle: it is sliced at any size. Rows are
told apart by the order columns: only rows equal in all of them share a slice for sure.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.lookup import BROADCAST_ROWS, lookup_join
from chronoloom.operators.sizes import hot_groups, hot_row_limit
from chronoloom.operators.storage import stored

SLICE = "_slice"
HALO = "_halo"
# Sampled rows per slice from which bounds are taken.
SAMPLED = 64

# Running aggregates: how a slice's own value is combined with what came before it.
_RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda own, before: F.coalesce(own + before, own, before)),
    "max": (F.max, lambda own, before: F.greatest(own, before)),
}

# A step that waits for those after it: what it adds, given the window, and its reach.
_Step = tuple[Callable[[WindowSpec], Mapping[str, Column]], int, int]


@dataclass(frozen=True)
class Timeline:
    """Rows ordered by ``order`` within the groups of ``part``.

    ``order`` names columns, a leading "-" means descending. The first is the time (or the ranked
    value); the rest break ties. ``plain`` has the rows of groups below the limit, ``large`` those
    of the groups above it with their slices, and ``hot`` lists these with their row counts.
    ``written`` tells that reading ``large`` again costs no more than reading a table.
    """

    plain: DataFrame | None
    part: tuple[str, ...]
    order: tuple[str, ...]
    large: DataFrame | None = None
    hot: tuple = ()
    waiting: tuple[_Step, ...] = ()
    written: bool = False

    @classmethod
    def bounded(cls, df: DataFrame, part: Iterable[str], order: Iterable[str]) -> Timeline:
        """For groups whose size cannot grow with the data, such as one row per calendar month."""
        return cls(df, tuple(part), tuple(order))

    @classmethod
    def measured(
        cls,
        df: DataFrame,
        part: Iterable[str],
        order: Iterable[str],
        sizes_from: DataFrame | None = None,
    ) -> Timeline:
        """Count rows per group and slice the groups above the limit.

        ``sizes_from`` is a cheaper table to count in, with at least as many rows per group.
        """
        part, order = tuple(part), tuple(order)
        counted = df if sizes_from is None else sizes_from
        if part:
            hot = tuple(hot_groups(counted, part))
        else:
            total = counted.agg(F.count(F.lit(1)).alias("_rows")).collect()
            hot = tuple(r for r in total if r["_rows"] > 0)
        if not hot:
            return cls(df, part, order)
        plain, mine = _apart(df, part, hot)
        return cls(plain, part, order, _with_slices(mine, part, order, hot), hot)

    @property
    def sliced(self) -> bool:
        return bool(self.hot)

    @property
    def df(self) -> DataFrame:
        """The rows after all steps; with slices where there are any, -1 for groups without."""
        line = self._settled()
        if not line.sliced:
            return line.plain
        if line.plain is None:
            return line.large
        return line.plain.withColumn(SLICE, F.lit(-1)).unionByName(line.large)

    # -- plain steps -----------------------------------------------------------------------

    def _each(self, change: Callable[[DataFrame], DataFrame]) -> Timeline:
        return replace(
            self,
            plain=None if self.plain is None else change(self.plain),
            large=None if self.large is None else change(self.large),
        )

    def with_columns(self, columns: Mapping[str, Column]) -> Timeline:
        if self.waiting:
            return replace(self, waiting=(*self.waiting, (lambda _: columns, 0, 0)))
        return self._each(lambda df: df.withColumns(dict(columns)))

    def filter(self, condition: Column) -> Timeline:
        return self._settled()._each(lambda df: df.filter(condition))

    def rows(self) -> DataFrame:
        """The rows without bookkeeping columns."""
        return self.df.drop(SLICE)

    def reordered(self, order: Iterable[str]) -> Timeline:
        """Same groups in another order; they are as large as before and not counted again."""
        order = tuple(order)
        if not self.sliced:
            return replace(self, order=order)
        line = self._again()
        large = _with_slices(line.large.drop(SLICE), self.part, order, self.hot)
        return replace(line, order=order, large=large)

    # -- windows ---------------------------------------------------------------------------

    @property
    def _cells(self) -> tuple[str, ...]:
        return (*self.part, SLICE)

    def _window(self, cells: tuple[str, ...]) -> WindowSpec:
        return Window.partitionBy(*cells).orderBy(*sort_keys(self.order))

    def neighbours(
        self, build: Callable[[WindowSpec], Mapping[str, Column]], back: int = 0, ahead: int = 0
    ) -> Timeline:
        """Add columns that look at most ``back`` rows behind and ``ahead`` rows forward."""
        if not self.sliced:
            return self.with_columns(build(self._window(self.part)))
        return replace(self, waiting=(*self.waiting, (build, back, ahead)))

    def _settled(self) -> Timeline:
        """All waiting steps done, over one halo as wide as their reaches together: a row within
        the reach that is left has all it needs for the steps before."""
        if not self.waiting:
            return self
        columns = self.large.columns
        back = sum(step[1] for step in self.waiting)
        ahead = sum(step[2] for step in self.waiting)
        rows = self.large.withColumn(HALO, F.lit(False))
        if back:
            rows = rows.unionByName(self._halo(self.large, columns, self.order, -back))
        if ahead:
            rows = rows.unionByName(self._halo(self.large, columns, _reversed(self.order), ahead))
        plain = self.plain
        for build, _, _ in self.waiting:
            rows = rows.withColumns(dict(build(self._window(self._cells))))
            if plain is not None:
                plain = plain.withColumns(dict(build(self._window(self.part))))
        large = rows.filter(~F.col(HALO)).drop(HALO)
        return replace(self, plain=plain, large=large, waiting=(), written=False)

    def _again(self) -> Timeline:
        """All steps done and the large groups written, as what follows reads them repeatedly."""
        line = self._settled()
        if line.written:
            return line
        return replace(line, large=stored(line.large), written=True)

    def _halo(
        self, hot: DataFrame, columns: list[str], order: tuple[str, ...], reach: int
    ) -> DataFrame:
        """Copies of the rows just before (reach < 0) or after (reach > 0) every slice.

        Read in ``order``, a slice is preceded by the last rows of earlier slices, and those are
        all among the last ``|reach|`` rows of each slice.
        """
        size = abs(reach)
        edge = (
            hot.withColumn(
                "_nth",
                F.row_number().over(
                    Window.partitionBy(*self._cells).orderBy(*sort_keys(_reversed(order)))
                ),
            )
            .filter(F.col("_nth") <= size)
            .drop("_nth")
        )
        along = Window.partitionBy(*self.part).orderBy(
            F.col(SLICE).asc() if reach < 0 else F.col(SLICE).desc(), *sort_keys(order)
        )
        return (
            edge.withColumn(
                "_copies",
                F.collect_list(F.struct(*columns)).over(along.rowsBetween(-size, -1)),
            )
            .withColumn("_before", F.lag(SLICE).over(along))
            .filter(F.col("_before").isNull() | (F.col("_before") != F.col(SLICE)))
            .select(F.col(SLICE).alias("_target"), F.explode("_copies").alias("_row"))
            .select(
                *(F.col("_target").alias(c) if c == SLICE else F.col(f"_row.{c}") for c in columns),
                F.lit(True).alias(HALO),
            )
        )

    def running(self, totals: Mapping[str, tuple[str, Column, str]]) -> Timeline:
        """Add cumulative columns: name -> (sum | max, expression, rows | range | before).

        ``rows`` runs to the current row, ``range`` includes all rows with the same time, and
        ``before`` stops at the previous row.
        """

        def own(names: Mapping, cells: tuple[str, ...]) -> dict[str, Column]:
            return {
                name: _RUNNING[kind][0](expr).over(self._frame(frame, cells))
                for name, (kind, expr, frame) in names.items()
            }

        if not self.sliced:
            return self.with_columns(own(totals, self.part))
        line = self._again()
        plain = line.plain
        if plain is not None:
            plain = plain.withColumns(own(totals, self.part))
        shared = {name: t for name, t in totals.items() if t[2] == "range"}
        if shared:
            line = line._by_value(
                {name: _RUNNING[kind][0](expr) for name, (kind, expr, _) in shared.items()},
                {name: (kind, F.col(name), "rows") for name, (kind, _, _) in shared.items()},
            )
        single = {name: t for name, t in totals.items() if t[2] != "range"}
        if single:
            per_slice = {name: _RUNNING[kind][0](expr) for name, (kind, expr, _) in single.items()}
            carried = {name: _RUNNING[kind][0] for name, (kind, _, _) in single.items()}
            joined = line._carry_in(own(single, self._cells), per_slice, carried)
            combined = {
                name: _RUNNING[kind][1](F.col(name), F.col(f"_in_{name}"))
                for name, (kind, _, _) in single.items()
            }
            large = joined.withColumns(combined).drop(*(f"_in_{name}" for name in single))
            line = replace(line, large=large, written=False)
        return replace(line, plain=plain)

    def ranks(self, names: Mapping[str, str]) -> Timeline:
        """Add rank columns by the first order column: name -> rank | dense_rank | row_number."""
        functions = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}
        by_value = Window.partitionBy(*self.part).orderBy(*sort_keys(self.order[:1]))
        own = {
            name: functions[kind]()
            .over(self._window(self.part) if kind == "row_number" else by_value)
            .cast("bigint")
            for name, kind in names.items()
        }
        if not self.sliced:
            return self.with_columns(own)
        line = self._again()
        plain = None if line.plain is None else line.plain.withColumns(own)
        line = replace(line, plain=None)
        ranks = {name: kind for name, kind in names.items() if kind != "row_number"}
        if ranks:
            # A rank is one more than the rows with earlier values, a dense rank the number of
            # distinct values so far.
            line = line._by_value(
                {
                    name: F.count(F.lit(1)) if kind == "rank" else F.max(F.lit(1))
                    for name, kind in ranks.items()
                },
                {
                    name: ("sum", F.col(name), "before" if kind == "rank" else "rows")
                    for name, kind in ranks.items()
                },
                {
                    name: F.coalesce(F.col(name), F.lit(0)) + 1
                    for name, kind in ranks.items()
                    if kind == "rank"
                },
            )
        numbers = [name for name, kind in names.items() if kind == "row_number"]
        if numbers:
            line = line.running({name: ("sum", F.lit(1), "rows") for name in numbers})
        return replace(line, plain=plain)

    def _by_value(
        self,
        per_value: Mapping[str, Column],
        totals: Mapping[str, tuple[str, Column, str]],
        last: Mapping[str, Column] | None = None,
    ) -> Timeline:
        """Columns that rows of large groups with the same first order column share.

        They are aggregated per distinct value, which ``totals`` runs over and ``last`` finishes,
        and every row looks its own up.
        """
        first = self.order[0]
        keys = (*self.part, first.removeprefix("-"))
        values = stored(
            self.large.groupBy(*keys).agg(*(e.alias(n) for n, e in per_value.items()))
        )
        line = Timeline.measured(values, self.part, [first]).running(totals)
        found = (
            line.with_columns(last or {})
            .rows()
            .select(
                *(F.col(c).alias(f"_key_{c}") for c in keys),
                *(F.col(n).cast("bigint").alias(n) if last is not None else n for n in totals),
            )
        )
        large = lookup_join(
            self.large, found, {c: f"_key_{c}" for c in keys}, null_safe=True,
            right_rows=values.count(),
        )
        return replace(self, large=large.drop(*(f"_key_{c}" for c in keys)), written=False)

    def totals(self, aggregates: Mapping[str, Column]) -> Timeline:
        """Add whole-group aggregates to every row."""
        whole = Window.partitionBy(*self.part)
        own = {n: expr.over(whole) for n, expr in aggregates.items()}
        if not self.sliced:
            return self.with_columns(own)
        line = self._again()
        keys = {c: f"_key_{c}" for c in self.part}
        per_group = line.large.groupBy(*self.part).agg(
            *(expr.alias(n) for n, expr in aggregates.items())
        )
        if self.part:
            found = per_group.select(*(F.col(c).alias(k) for c, k in keys.items()), *aggregates)
            # One row per group above the limit, whose number is known.
            large = lookup_join(line.large, found, keys, null_safe=True, right_rows=len(self.hot))
            large = large.drop(*keys.values())
        else:
            large = line.large.withColumns({n: per_group.select(n).scalar() for n in aggregates})
        plain = None if line.plain is None else line.plain.withColumns(own)
        return replace(line, plain=plain, large=large, written=False)

    def _frame(self, frame: str, cells: tuple[str, ...]) -> WindowSpec:
        if frame == "rows":
            return self._window(cells).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if frame == "before":
            return self._window(cells).rowsBetween(Window.unboundedPreceding, -1)
        if frame == "range":
            by_time = Window.partitionBy(*cells).orderBy(*sort_keys(self.order[:1]))
            return by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        raise ValueError(f"frame must be rows, range or before, not {frame!r}")

    def _carry_in(
        self,
        own: Mapping[str, Column],
        per_slice: Mapping[str, Column],
        accumulate: Mapping[str, Callable[[Column], Column]],
    ) -> DataFrame:
        """Rows with their own totals and what the earlier slices add up to (one row a slice)."""
        earlier = (
            Window.partitionBy(*self.part)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            self.large.groupBy(*self._cells)
            .agg(*(expr.alias(f"_own_{name}") for name, expr in per_slice.items()))
            .select(
                *(F.col(c).alias(f"_key_{c}") for c in self.part),
                F.col(SLICE).alias("_key_slice"),
                *(
                    accumulate[name](F.col(f"_own_{name}")).over(earlier).alias(f"_in_{name}")
                    for name in per_slice
                ),
            )
        )
        same = F.col(SLICE) == F.col("_key_slice")
        for c in self.part:
            same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        return self.large.withColumns(dict(own)).join(carry, same, "left").drop(
            "_key_slice", *(f"_key_{c}" for c in self.part)
        )


def _listed(df: DataFrame, part: tuple[str, ...], hot: tuple) -> tuple[DataFrame, list[str]]:
    """The groups above the limit as a table, with the slices each gets."""
    spark = df.sparkSession
    limit = hot_row_limit(spark)
    least = 2 if part else int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_hot_{i}" for i in range(len(part))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, part)]
    fields.append(T.StructField("_slices", T.IntegerType()))
    rows = [(*(r[c] for c in part), max(least, math.ceil(4 * r["_rows"] / limit))) for r in hot]
    return spark.createDataFrame(rows, T.StructType(fields)), names


def _apart(
    df: DataFrame, part: tuple[str, ...], hot: tuple
) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the groups below the limit, and of those above it."""
    if not part:
        return None, df
    listed, names = _listed(df, part, hot)
    same = F.lit(True)
    for c, n in zip(part, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    small = F.broadcast(listed) if len(hot) <= BROADCAST_ROWS else listed
    return df.join(small, same, "left_anti"), df.join(small, same, "left_semi")


def _with_slices(
    df: DataFrame, part: tuple[str, ...], order: tuple[str, ...], hot: tuple
) -> DataFrame:
    """Rows of the listed groups with SLICE, the number of bounds not after the row."""
    spark = df.sparkSession
    listed, names = _listed(df, part, hot)
    slices = listed.agg(F.sum("_slices")).first()[0]
    every = max(1, sum(r["_rows"] for r in hot) // (SAMPLED * slices))
    columns = [c.removeprefix("-") for c in order]
    chosen = df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(every)) == 0).select(
        *part, *(F.col(c) for c in columns if c not in part)
    )
    sampled = _attached(chosen, listed, part, names, len(hot), "inner")
    group = Window.partitionBy(*part)
    place = F.floor(
        F.row_number().over(group.orderBy(*sort_keys(order)))
        * F.col("_slices")
        / (F.count(F.lit(1)).over(group) + 1)
    )
    bound = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(columns)))
    bounds = (
        sampled.withColumn("_place", place)
        .withColumn("_before", F.lag("_place", 1, 0).over(group.orderBy(*sort_keys(order))))
        .filter(F.col("_place") > F.col("_before"))
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list(F.struct("_place", bound.alias("_bound")))).alias("_found"))
        .select(
            *(F.col(c).alias(n) for c, n in zip(part, names)),
            F.transform("_found", lambda x: x["_bound"]).alias("_bounds"),
        )
    )
    # At most four bounds per limit of rows: collected, so that no later step samples again.
    known = bounds.collect()
    most = max((len(r["_bounds"]) for r in known), default=0)
    table = spark.createDataFrame(known, bounds.schema)
    rows = _attached(df, table, part, names, sum(len(r["_bounds"]) for r in known), "left")
    number = F.coalesce(bounds_passed("_bounds", order, most), F.lit(0))
    return rows.withColumn(SLICE, number).drop("_bounds", *names)


def _attached(
    df: DataFrame, table: DataFrame, part: tuple, names: list[str], size: int, how: str
) -> DataFrame:
    """``df`` with the row of its group; the table is sent around only if it is small."""
    if not part:
        return df.withColumns({c: table.select(c).scalar() for c in table.columns})
    same = F.lit(True)
    for c, n in zip(part, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    small = F.broadcast(table) if size <= BROADCAST_ROWS else table
    return df.join(small, same, how)


def bounds_passed(bounds: str, order: tuple[str, ...], most: int) -> Column:
    """How many of the sorted bounds are not after the row, by binary search."""

    def not_after(bound: Column) -> Column:
        passed = F.lit(True)
        for i, c in reversed(list(enumerate(order))):
            theirs, own = bound[f"_o{i}"], F.col(c.removeprefix("-"))
            if c.startswith("-"):
                first = (theirs > own) | (theirs.isNotNull() & own.isNull())
            else:
                first = (theirs < own) | (theirs.isNull() & own.isNotNull())
            passed = F.coalesce(first, F.lit(False)) | (theirs.eqNullSafe(own) & passed)
        return passed

    def halved(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        step = F.struct(
            F.when(not_after(F.get(F.col(bounds), middle)), middle + 1).otherwise(low).alias("low"),
            F.when(not_after(F.get(F.col(bounds), middle)), high).otherwise(middle).alias("high"),
        )
        return F.when(low < high, step).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    steps = F.sequence(F.lit(0), F.lit(max(1, most).bit_length()))
    found = F.aggregate(steps, start, halved, lambda state: state["low"])
    return F.when(F.col(bounds).isNotNull(), found)


def sort_keys(order: Iterable[str]) -> list[Column]:
    return [
        F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first()
        for c in order
    ]


def _reversed(order: Iterable[str]) -> tuple[str, ...]:
    return tuple(c[1:] if c.startswith("-") else f"-{c}" for c in order)
