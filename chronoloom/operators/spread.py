"""Islands of many groups from summaries that merge, without counting or splitting groups first.

All rows are dealt into slices of one order, by group and then by time, whatever the groups' sizes:
a small group lies in one slice, a huge one in many, and no window sees more than a slice. Rows are
shuffled once. What a slice must know of the others is carried in two small tables:

* the last ``back`` rows before it, put in front of its own as halo rows;
* how many islands its first group has begun before it.

Each slice folds its rows into one summary per island. A summary is merged by min, max and sum, so
the pieces of an island that crosses borders add up to it in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.storage import stored
from chronoloom.operators.timeline import HALO, SAMPLED, SLICE, bounds_passed, sort_keys

# Slices per shuffle partition, so that the hash of their numbers fills partitions evenly.
SLICES_PER_PARTITION = 4

_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True)
class Spread:
    """Rows in slices, each preceded by its halo; made by ``dealt``."""

    df: DataFrame
    part: tuple[str, ...]
    order: tuple[str, ...]

    @classmethod
    def dealt(
        cls, df: DataFrame, part: Iterable[str], order: Iterable[str], back: int,
        slices: int | None = None,
    ) -> Spread:
        """``df`` in slices of (``part``, ``order``), ascending, unknown values first.

        ``back`` is how many rows all later steps look behind, added up. The bounds come from a
        sample of fixed size per slice; they decide how even slices are and nothing else.
        """
        part, order = tuple(part), tuple(order)
        spark = df.sparkSession
        if slices is None:
            slices = SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
        along = (*part, *order)
        sliced = _numbered(df, along, slices).repartition(SLICE)
        first = F.row_number().over(Window.partitionBy(SLICE).orderBy(*sort_keys(along))) == 1
        # At most one row per slice.
        before = F.broadcast(_tails(sliced, df.columns, along, back))
        led = sliced.withColumn("_first", first).join(
            before, (F.col(SLICE) == F.col("_of")) & F.col("_first"), "left"
        )
        # Halo rows of other groups harm nothing: windows run within a group.
        own = F.array(F.struct(*df.columns, F.lit(False).alias(HALO)))
        rows = F.when(F.col("_halo_rows").isNull(), own).otherwise(F.concat("_halo_rows", own))
        return cls(led.select(SLICE, F.inline(rows)), part, order)

    def _window(self) -> WindowSpec:
        return Window.partitionBy(SLICE, *self.part).orderBy(*sort_keys(self.order))

    def neighbours(
        self, build: Callable[[WindowSpec], Mapping[str, Column]], back: int = 0
    ) -> Spread:
        """Add columns that look at rows behind, within the reach given to ``dealt``."""
        return self.with_columns(build(self._window()))

    def with_columns(self, columns: Mapping[str, Column]) -> Spread:
        return replace(self, df=self.df.withColumns(dict(columns)))

    def islands(
        self, start: Column, keep: Column, parts: Mapping[str, tuple[str, Column]], name: str
    ) -> DataFrame:
        """One row per group and island that has a row to ``keep``: its number ``name`` (the starts
        of the group so far) and the figures of ``parts`` over the rows kept.

        ``parts`` maps names to (min | max | sum, expression of a row).
        """
        so_far = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = self.df.filter(~F.col(HALO)).withColumn("_start", start)
        # All rows that are not kept make one piece per group and slice, which only counts starts.
        number = F.when(keep, F.sum("_start").over(so_far))
        pieces = stored(
            own.withColumn("_piece", number)
            .groupBy(SLICE, *self.part, "_piece")
            .agg(
                F.sum("_start").alias("_starts"),
                *(_MERGE[kind](expr).alias(n) for n, (kind, expr) in parts.items()),
            )
        )
        carried = F.broadcast(self._carried(pieces))
        first = F.struct(*self.part).eqNullSafe(F.col("_group"))
        return (
            pieces.filter(F.col("_piece").isNotNull())
            .join(carried, (F.col(SLICE) == F.col("_of")) & first, "left")
            .withColumn(name, F.col("_piece") + F.coalesce("_begun", F.lit(0)))
            .groupBy(*self.part, name)
            .agg(*(_MERGE[kind](F.col(n)).alias(n) for n, (kind, _) in parts.items()))
        )

    def _carried(self, pieces: DataFrame) -> DataFrame:
        """(_of, _group, _begun): per slice that goes on with the group of the one before, that
        group and its starts before the slice. At most one row per slice."""
        groups = pieces.groupBy(SLICE, F.struct(*self.part).alias("_group")).agg(
            F.sum("_starts").alias("_total")
        )
        slices = groups.groupBy(SLICE).agg(
            F.min("_group").alias("_opens"),
            F.max("_group").alias("_ends"),
            F.max_by("_total", "_group").alias("_total"),
        )
        along = Window.orderBy(SLICE)
        begun = F.sum("_total").over(Window.partitionBy("_ends").orderBy(SLICE))
        return (
            slices.withColumn("_sum", begun)
            .select(
                F.col(SLICE).alias("_of"),
                F.col("_opens").alias("_group"),
                F.lag("_ends").over(along).alias("_last"),
                F.lag("_sum").over(along).alias("_begun"),
            )
            .filter(F.col("_last").eqNullSafe(F.col("_group")) & F.col("_begun").isNotNull())
            .drop("_last")
        )


def _numbered(df: DataFrame, along: tuple[str, ...], slices: int) -> DataFrame:
    """``df`` with its slice: the number of bounds not after the row, a function of the row."""
    sampled = (
        df.select(*along)
        .withColumn("_chance", F.xxhash64(*along))
        .orderBy("_chance", *along)
        .limit(SAMPLED * slices)
    )
    bound = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(along)))
    # SAMPLED rows per slice are sorted, one per slice is collected.
    tiles = (
        sampled.withColumn("_tile", F.ntile(slices).over(Window.orderBy(*sort_keys(along))))
        .groupBy("_tile")
        .agg(F.min(bound).alias("_bound"))
        .filter(F.col("_tile") > 1)
        .orderBy("_tile")
    )
    found = tiles.collect()
    kind = T.StructType([T.StructField("_bounds", T.ArrayType(tiles.schema["_bound"].dataType))])
    table = df.sparkSession.createDataFrame([([r["_bound"] for r in found],)], kind)
    rows = df.withColumn("_bounds", table.select("_bounds").scalar())
    number = F.coalesce(bounds_passed("_bounds", along, len(found)), F.lit(0))
    return rows.withColumn(SLICE, number).drop("_bounds")


def _tails(rows: DataFrame, columns: list[str], along: tuple[str, ...], back: int) -> DataFrame:
    """(_of, _halo_rows): per slice the last ``back`` rows of all slices before it, in order."""
    latest = Window.partitionBy(SLICE).orderBy(*(F.col(c).desc_nulls_last() for c in along))
    row = F.struct(*columns, F.lit(True).alias(HALO))
    tails = (
        rows.withColumn("_nth", F.row_number().over(latest))
        .filter(F.col("_nth") <= back)
        .groupBy(SLICE)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("_nth"), row.alias("_row")))).alias("_t"))
        .select(SLICE, F.transform("_t", lambda x: x["_row"]).alias("_tail"))
    )
    # One row per slice; each has a row at least, so ``back`` slices hold ``back`` rows.
    before = Window.orderBy(SLICE).rowsBetween(-max(1, back), -1)
    joined = F.flatten(F.collect_list("_tail").over(before))
    return tails.select(
        F.col(SLICE).alias("_of"),
        F.slice(joined, F.greatest(F.size(joined) - back, F.lit(0)) + 1, back).alias("_halo_rows"),
    )
