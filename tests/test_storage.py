"""Scopes, shared stages, laid out tables and one order over a whole table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.operators import ranges, storage
from chronoloom.operators.sizes import HOT_ROWS_CONF
from chronoloom.plans import instability
from chronoloom.sources import layout
from chronoloom.sources.inputs import Inputs


def files_below(folder: str) -> list[str]:
    root = folder.removeprefix("file:")
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]


def test_nothing_is_left_after_a_scope(spark):
    outside = storage.stored(spark.range(5))
    with storage.scope(spark) as folder:
        kept = storage.stored(spark.range(100))
        with storage.scope(spark) as inner:
            assert storage.stored(spark.range(7)).count() == 7
            assert files_below(inner)
        assert not os.path.exists(inner.removeprefix("file:"))
        assert kept.count() == 100 and storage.stored(kept).count() == 100
        assert files_below(folder)
    assert not os.path.exists(folder.removeprefix("file:"))
    assert outside.count() == 5
    assert storage.stored(spark.range(3)).count() == 3


def test_nothing_is_left_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError):
        with storage.scope(spark) as folder:
            storage.stored(spark.range(10))
            raise ZeroDivisionError
    assert not os.path.exists(folder.removeprefix("file:")) and not storage._scopes


def test_a_query_that_stores_large_groups_leaves_no_files(spark, small):
    found = {}
    spark.conf.set(HOT_ROWS_CONF, "20")
    try:
        with storage.scope(spark) as folder:
            found["rows"] = registry.queries()["energy_anomaly"](spark, small).count()
            found["files"] = len(files_below(folder))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert found["files"] > 0 and not os.path.exists(folder.removeprefix("file:"))
    assert found["rows"] == registry.queries()["energy_anomaly"](spark, small).count()


def test_registered_checks_share_their_metrics(spark, small, monkeypatch):
    built = []
    original = registry.brands.brand_metrics
    monkeypatch.setattr(registry.brands, "brand_metrics", lambda *a, **k: built.append(1) or original(*a, **k))
    names = ["brand_metrics", "brand_checks_total", "brand_checks_ticket", "brand_checks_flags"]
    results = {}
    registry.write_all(spark, small, names, lambda name, df: results.update({name: sorted(map(str, df.collect()))}))
    assert len(built) == 1 and list(results) == names
    alone = {name: sorted(map(str, registry.queries()[name](spark, small).collect())) for name in names}
    assert results == alone and len(built) == 5


def test_a_cluster_is_asked_for_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage._configured(Session())


def test_one_order_over_a_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    found = ranges.numbered(df.repartition(5), [F.col("g").desc(), F.col("v")], "n", ranges=7)
    rows = sorted(found.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 1001))
    assert [(-r.g, r.v) for r in rows] == sorted((-r.g, r.v) for r in rows)
    counted = df.groupBy("g").agg(F.count(F.lit(1)).alias("copies"))
    again = ranges.numbered(counted, [F.col("g")], "n", copies="copies").collect()
    assert sorted(r.n for r in again) == list(range(1, 1001))
    assert [r.g for r in sorted(again, key=lambda r: r.n)] == [0] * 334 + [1] * 333 + [2] * 333
    sums = {r["_of"]: r["_before"] for r in ranges.carried(ranges.sorted_ranges(df, [F.col("v")], 4), F.col("v")).collect()}
    assert sums[min(sums)] == 0 and len(sums) == 4 and max(sums.values()) < 999 * 500
    assert ranges.numbered(df.limit(0), [F.col("v")], "n").count() == 0


def test_a_sorted_report_is_read_in_order(spark, tmp_path):
    df = spark.range(2000).select(
        F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") * 7919 % 500).alias("a"), F.col("id").alias("b"))
    path = f"file:{tmp_path}/report"
    found = layout.write_sorted(df.repartition(6), ["a", "b"], path, ranges=5).orderBy("number").collect()
    assert len(found) == 5 and sum(r.rows for r in found) == 2000
    rows = [(r.a, r.b) for r in layout.rows_in_order(spark, path)]
    wanted = sorted(((r.a, r.b) for r in df.collect()), key=lambda x: (x[0] is not None, x))
    assert rows == wanted
    low, high = (F.struct(F.lit(v).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) for v in (200, 210))
    few = layout.files_in_order(spark, path, low, high)
    assert 1 <= len(few) < 5
    held = spark.read.parquet(*few).filter("a between 200 and 209").count()
    assert held == df.filter("a between 200 and 209").count()
    layout.drop(spark, path)
    assert not (tmp_path / "report").exists()


def test_a_table_by_entity_needs_no_exchange(spark, small, tmp_path, capsys):
    readings = Inputs(spark, small).readings()
    table = layout.write_by_entity(
        readings, "readings_by_entity", "entity_id", ["event_time", "event_id"], 4, f"file:{tmp_path}/t")
    args = {"entity": "entity_id", "ts": "event_time", "tie": ["event_id"], "value": "reading", "gap_minutes": 1440}
    try:
        found = instability.energy_anomaly(table, **args)
        capsys.readouterr()
        found.explain()
        assert "Exchange" not in capsys.readouterr().out
        joined = table.join(
            table.groupBy("entity_id").agg(F.max("reading").alias("top")), "entity_id")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined.explain()
        assert "Exchange" not in capsys.readouterr().out
        wanted = instability.energy_anomaly(readings, **args)
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table readings_by_entity")
