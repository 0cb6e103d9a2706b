"""Periods of anomalous readings: terminals, nodes, devices, sensors, machines, batch jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import boundary_diff, flag
from chronoloom.operators import islands as isl
from chronoloom.operators.rolling import deviates, exceeds, trailing_mean
from chronoloom.operators.series import split_series
from chronoloom.operators.spread import Spread
from chronoloom.operators.timeline import Timeline
from chronoloom.plans._common import report


def _line(df: DataFrame, entity: str, ts: str, tie: Iterable[str], *values: str) -> Timeline:
    tie = [c for c in tie if c not in values]
    return Timeline.measured(df.select(entity, ts, *tie, *values), [entity], [ts, *tie])


def _spread(
    df: DataFrame, entity: str, ts: str, tie: Iterable[str], back: int, *values: str
) -> Spread:
    tie = [c for c in tie if c not in values]
    return Spread.dealt(df.select(entity, ts, *tie, *values), [entity], [ts, *tie], back)


def _span(ts: str, first: str, last: str) -> list:
    return [F.min(ts).alias(first), F.max(ts).alias(last)]


def temperature_jumps(
    readings: DataFrame, *, ts: str = "data_leitura", value: str = "temperatura",
    tie: Iterable[str] = ("leitura_id",), limit: float = 1.5, ordered: bool = False,
) -> DataFrame:
    """Split one global series wherever a reading is more than ``limit`` above the one before."""
    order = [ts, *tie]
    groups = split_series(
        readings.select(value, *order),
        order,
        value,
        lambda now, before: flag(now - before > limit),
        {
            "inicio_periodo": ("min", F.col(ts)),
            "fim_periodo": ("max", F.col(ts)),
            "temp_min": ("min", F.col(value)),
            "temp_max": ("max", F.col(value)),
            "total_leituras": ("sum", F.lit(1)),
        },
    )
    return report(groups, ["grupo_id"], ordered)


def terminal_instability(
    readings: DataFrame, *, entity: str = "terminal_id", ts: str = "check_time",
    status: str = "status_code", latency: str = "latency_ms", tie: Iterable[str] = (),
    factor: float = 1.3, gap_minutes: int = 5, min_minutes: int = 10, min_unstable: int = 2,
    spread: bool = False, ordered: bool = False,
) -> DataFrame:
    """Unstable stretches: a bad status, or latency at least ``factor`` times the one before.

    With ``spread``, summaries of slices are merged instead of a window per terminal.
    """
    if spread:
        line = _spread(readings, entity, ts, tie, 1, status, latency)
    else:
        line = _line(readings, entity, ts, tie, status, latency)
    line = line.neighbours(
        lambda w: {"_latency": F.lag(latency).over(w), "_time": F.lag(ts).over(w)}, back=1
    )
    line = line.with_columns(
        {
            "instavel": flag(
                (F.col(status) != 0) | (F.col(latency) >= F.col("_latency") * factor)
            ),
            "_gap": isl.gap_flag("minute", "_time", ts, gap_minutes),
        }
    )
    start = isl.start_flag(isl.BREAK, "instavel", "_gap")
    long_enough = (F.col("duracao_minutos") >= min_minutes) & (
        F.col("qtd_instaveis") >= min_unstable
    )
    if spread:
        merged = line.islands(
            start,
            F.col("instavel") == 1,
            {
                "inicio_periodo": ("min", F.col(ts)),
                "fim_periodo": ("max", F.col(ts)),
                "qtd_leituras": ("sum", F.lit(1)),
                "qtd_instaveis": ("sum", F.col("instavel")),
                "max_latency": ("max", F.col(latency)),
            },
            "grupo_id",
        )
        found = merged.select(
            entity, "grupo_id", "inicio_periodo", "fim_periodo",
            boundary_diff("minute", "inicio_periodo", "fim_periodo").alias("duracao_minutos"),
            "qtd_leituras", "qtd_instaveis", "max_latency",
        ).filter(long_enough)
        return report(found, [entity, "inicio_periodo"], ordered)
    line = isl.assign_islands(line, start)
    found = isl.summarize_islands(
        line.rows().filter(F.col("instavel") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio_periodo", "fim_periodo"),
            boundary_diff("minute", F.min(ts), F.max(ts)).alias("duracao_minutos"),
            F.count(F.lit(1)).alias("qtd_leituras"),
            F.sum("instavel").alias("qtd_instaveis"),
            F.max(latency).alias("max_latency"),
        ],
        long_enough,
    )
    return report(found, [entity, "inicio_periodo"], ordered)


def node_instability(
    readings: DataFrame, *, entity: str = "node_id", ts: str = "check_time",
    status: str = "status_code", latency: str = "latency_ms", tie: Iterable[str] = (),
    factor: float = 1.4, gap_minutes: int = 3, min_minutes: int = 5, ordered: bool = False,
) -> DataFrame:
    """As defined, every unstable reading opens its own period, so periods last 0 minutes and
    the default duration filter leaves none; pass ``min_minutes=0`` to see them."""
    line = _line(readings, entity, ts, tie, status, latency)
    line = line.neighbours(
        lambda w: {"_latency": F.lag(latency).over(w), "_time": F.lag(ts).over(w)}, back=1
    )
    line = line.with_columns(
        {
            "_unstable": flag(
                (F.col(status) > 0) | (F.col(latency) > F.col("_latency") * factor)
            ),
            "_gap": isl.gap_flag("minute", "_time", ts, gap_minutes),
        }
    )
    line = isl.assign_islands(
        line, isl.start_flag(isl.EVENT, "_unstable", "_gap"), frame="range"
    )
    found = isl.summarize_islands(
        line.rows().filter(F.col("_unstable") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio", "fim"),
            boundary_diff("minute", F.min(ts), F.max(ts)).alias("minutos"),
            F.max(status).alias("pior_status"),
            F.max(latency).alias("max_lat"),
        ],
        F.col("minutos") >= min_minutes,
    )
    return report(found, [entity, "inicio"], ordered)


def device_irregular(
    readings: DataFrame, *, entity: str = "device_id", ts: str = "event_time",
    temp: str = "temp", pressure: str = "pressure", tie: Iterable[str] = (),
    temp_rows: int = 3, temp_tolerance: float = 0.15,
    pressure_rows: int = 4, pressure_tolerance: float = 0.10,
    gap_seconds: int = 90, min_seconds: int = 120, ordered: bool = False,
) -> DataFrame:
    """Stretches where temperature or pressure is off its own trailing mean."""
    line = _line(readings, entity, ts, tie, temp, pressure)
    line = line.neighbours(
        lambda w: {
            "_temp": trailing_mean(temp, temp_rows, w),
            "_pressure": trailing_mean(pressure, pressure_rows, w),
            "_time": F.lag(ts).over(w),
        },
        back=max(temp_rows, pressure_rows),
    )
    line = line.with_columns(
        {
            "_temp_off": deviates(temp, "_temp", temp_tolerance),
            "_pressure_off": deviates(pressure, "_pressure", pressure_tolerance),
            "_gap": isl.gap_flag("second", "_time", ts, gap_seconds),
        }
    ).with_columns({"_off": F.greatest("_temp_off", "_pressure_off")})
    line = isl.assign_islands(line, isl.start_flag(isl.BREAK, "_off", "_gap"))
    found = isl.summarize_islands(
        line.rows().filter(F.col("_off") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio", "fim"),
            boundary_diff("second", F.min(ts), F.max(ts)).alias("duracao"),
            F.sum("_temp_off").alias("qtd_temp_irreg"),
            F.sum("_pressure_off").alias("qtd_press_irreg"),
        ],
        F.col("duracao") >= min_seconds,
    )
    return report(found, [entity, "inicio"], ordered)


def sensor_drift(
    readings: DataFrame, *, entity: str = "device_id", ts: str = "event_time",
    value: str = "reading", tie: Iterable[str] = (), rows: int = 5, tolerance: float = 0.12,
    gap_seconds: int = 120, min_seconds: int = 180, ordered: bool = False,
) -> DataFrame:
    """Stretches where a sensor is off the mean of its last ``rows`` readings."""
    line = _line(readings, entity, ts, tie, value)
    line = line.neighbours(
        lambda w: {"_mean": trailing_mean(value, rows, w), "_time": F.lag(ts).over(w)}, back=rows
    )
    line = line.with_columns(
        {
            "_off": deviates(value, "_mean", tolerance),
            "_gap": isl.gap_flag("second", "_time", ts, gap_seconds),
        }
    )
    line = isl.assign_islands(line, isl.start_flag(isl.BREAK, "_off", "_gap"))
    found = isl.summarize_islands(
        line.rows().filter(F.col("_off") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio", "fim"),
            boundary_diff("second", F.min(ts), F.max(ts)).alias("duracao"),
            F.count(F.lit(1)).alias("qtd_leituras"),
        ],
        F.col("duracao") >= min_seconds,
    )
    return report(found, [entity, "inicio"], ordered)


def energy_anomaly(
    readings: DataFrame, *, entity: str = "machine_id", ts: str = "reading_time",
    value: str = "energy_kw", tie: Iterable[str] = (), rows: int = 6, factor: float = 1.25,
    gap_minutes: int = 2, min_minutes: int = 10, policy: str = isl.BREAK,
    spread: bool = False, ordered: bool = False,
) -> DataFrame:
    """Stretches of use above ``factor`` times the mean of the last ``rows`` readings.

    With ``spread``, summaries of slices are merged instead of a window per machine.
    """
    if spread:
        # The flag of the row before needs one row more.
        line = _spread(readings, entity, ts, tie, rows + 1, value)
    else:
        line = _line(readings, entity, ts, tie, value)
    line = line.neighbours(
        lambda w: {"_mean": trailing_mean(value, rows, w), "_time": F.lag(ts).over(w)}, back=rows
    )
    line = line.with_columns(
        {
            "_high": exceeds(value, "_mean", factor),
            "_gap": isl.gap_flag("minute", "_time", ts, gap_minutes),
        }
    )
    if policy == isl.ONSET:
        line = line.neighbours(lambda w: {"_was_high": F.lag("_high").over(w)}, back=1)
    start = isl.start_flag(policy, "_high", "_gap", "_time", "_was_high")
    if spread:
        merged = line.islands(
            start,
            F.col("_high") == 1,
            {
                "inicio": ("min", F.col(ts)),
                "fim": ("max", F.col(ts)),
                "qtd_leituras": ("sum", F.lit(1)),
            },
            "grupo_id",
        )
        found = merged.select(
            entity, "grupo_id", "inicio", "fim",
            boundary_diff("minute", "inicio", "fim").alias("duracao"), "qtd_leituras",
        ).filter(F.col("duracao") >= min_minutes)
        return report(found, [entity, "inicio"], ordered)
    line = isl.assign_islands(line, start)
    found = isl.summarize_islands(
        line.rows().filter(F.col("_high") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio", "fim"),
            boundary_diff("minute", F.min(ts), F.max(ts)).alias("duracao"),
            F.count(F.lit(1)).alias("qtd_leituras"),
        ],
        F.col("duracao") >= min_minutes,
    )
    return report(found, [entity, "inicio"], ordered)


def job_degraded(
    runs: DataFrame, *, entity: str = "job_id", ts: str = "event_time",
    elapsed: str = "processing_time_ms", errors: str = "error_count", tie: Iterable[str] = (),
    slow_ms: float = 2000, gap_minutes: int = 3, min_minutes: int = 10, ordered: bool = False,
) -> DataFrame:
    """Degraded periods of batch jobs: slow runs or runs with errors; unknown errors count 0."""
    line = _line(runs, entity, ts, tie, elapsed, errors)
    line = line.with_columns({errors: F.coalesce(errors, F.lit(0))})
    line = line.with_columns(
        {"_bad": flag((F.col(elapsed) > slow_ms) | (F.col(errors) > 0))}
    )
    line = line.neighbours(
        lambda w: {"_time": F.lag(ts).over(w), "_was_bad": F.lag("_bad").over(w)}, back=1
    )
    line = line.with_columns(
        {"_gap": isl.gap_flag("minute", "_time", ts, gap_minutes, first_is_gap=False)}
    )
    line = isl.assign_islands(
        line, isl.start_flag(isl.ONSET, "_bad", "_gap", "_time", "_was_bad")
    )
    found = isl.summarize_islands(
        line.rows().filter(F.col("_bad") == 1),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio_periodo", "fim_periodo"),
            boundary_diff("minute", F.min(ts), F.max(ts)).alias("duracao_minutos"),
            F.max(elapsed).alias("pior_processing_time"),
            F.sum(errors).alias("total_erros"),
        ],
        F.col("duracao_minutos") >= min_minutes,
    )
    return report(found, [entity, "inicio_periodo"], ordered)


def job_span(
    runs: DataFrame, *, entity: str = "job_id", ts: str = "event_time",
    elapsed: str = "processing_time_ms", errors: str = "error_count",
    min_minutes: int = 10, ordered: bool = False,
) -> DataFrame:
    """Whole observed span per batch job, its slowest run and the runs with a known error count."""
    spans = runs.groupBy(entity).agg(
        *_span(ts, "inicio_periodo", "fim_periodo"),
        boundary_diff("minute", F.min(ts), F.max(ts)).alias("duracao_minutos"),
        F.max(elapsed).alias("pior_processing_time"),
        F.count(errors).alias("qtd_erros"),
    )
    return report(
        spans.filter(F.col("duracao_minutos") >= min_minutes),
        [entity, "inicio_periodo"],
        ordered,
    )


def job_degraded_loose(
    runs: DataFrame, *, entity: str = "job_id", ts: str = "event_time",
    elapsed: str = "processing_time_ms", errors: str = "error_count", tie: Iterable[str] = (),
    slow_ms: float = 2000, gap_minutes: int = 3, min_minutes: int = 10, ordered: bool = False,
) -> DataFrame:
    """Periods that open at a degraded run after a gap (or the first run) and then take in every
    run, normal ones too, until the next opens. Period 0 holds what comes before the first."""
    line = _line(runs, entity, ts, tie, elapsed, errors)
    line = line.neighbours(lambda w: {"_time": F.lag(ts).over(w)}, back=1)
    line = line.with_columns(
        {
            "_bad": flag(
                (F.col(elapsed) > slow_ms) | (F.coalesce(errors, F.lit(0)) > 0)
            ),
            "_gap": isl.gap_flag("minute", "_time", ts, gap_minutes, first_is_gap=False),
        }
    )
    line = isl.assign_islands(line, isl.start_flag(isl.FIRST_OR_GAP, "_bad", "_gap", "_time"))
    found = isl.summarize_islands(
        line.rows(),
        [entity, "grupo_id"],
        [
            *_span(ts, "inicio_periodo", "fim_periodo"),
            boundary_diff("minute", F.min(ts), F.max(ts)).alias("duracao_minutos"),
            F.sum(errors).alias("total_erros"),
            F.max(elapsed).alias("pior_ms"),
        ],
        F.col("duracao_minutos") >= min_minutes,
    )
    return report(found, [entity, "grupo_id"], ordered)


def seller_decline(
    daily: DataFrame, *, entity: str = "seller_id", day: str = "sale_date",
    orders: str = "total_orders", revenue: str = "total_revenue", rows: int = 7,
    orders_factor: float = 0.60, revenue_factor: float = 0.50, min_days: int = 3,
    ordered: bool = False,
) -> DataFrame:
    """Runs of consecutive days on which a seller is far below the mean of the last ``rows``.

    The input has one row per seller and day, so a seller's rows are bounded by the calendar.
    """
    line = Timeline.bounded(daily.select(entity, day, orders, revenue), [entity], [day])
    line = line.neighbours(
        lambda w: {
            "_orders": trailing_mean(orders, rows, w),
            "_revenue": trailing_mean(revenue, rows, w),
            "_day": F.lag(day).over(w),
        },
        back=rows,
    )
    line = line.with_columns(
        {
            "_low": flag(
                F.col("_orders").isNotNull()
                & (
                    (F.col(orders) < F.col("_orders") * orders_factor)
                    | (F.col(revenue) < F.col("_revenue") * revenue_factor)
                )
            ),
            "_gap": 1 - flag(boundary_diff("day", "_day", day) == 1),
        }
    )
    line = line.neighbours(lambda w: {"_was_low": F.lag("_low").over(w)}, back=1)
    line = isl.assign_islands(line, isl.start_flag(isl.ONSET, "_low", "_gap", "_day", "_was_low"))
    found = isl.summarize_islands(
        line.rows().filter(F.col("_low") == 1),
        [entity, "grupo_id"],
        [
            *_span(day, "inicio_queda", "fim_queda"),
            F.count(F.lit(1)).alias("duracao_dias"),
            F.min(orders).alias("pior_dia_orders"),
            F.min(revenue).alias("pior_dia_revenue"),
            F.avg("_orders").alias("media_orders_baseline"),
            F.avg("_revenue").alias("media_revenue_baseline"),
        ],
        F.col("duracao_dias") >= min_days,
    )
    return report(found, [entity, "inicio_queda"], ordered)
