from __future__ import annotations

import pytest

from chronoloom.operators import lookup, validity
from chronoloom.operators.dedup import keep_latest
from chronoloom.operators.sizes import HOT_ROWS_CONF
from chronoloom.operators.validity import interval_match_best

FACTS = [
    (1, "2024-01-01 00:00:00", "at the start"),
    (1, "2024-03-31 00:00:00", "at the end"),
    (1, "2024-03-31 00:00:01", "just after"),
    (1, "2023-12-31 23:59:59", "just before"),
    (1, "2024-02-15 12:00:00", "two cover"),
    (2, "2024-02-15 12:00:00", "open end"),
    (3, "2024-02-15 12:00:00", "no versions"),
    (None, "2024-02-15 12:00:00", "no key"),
    (4, "2024-05-05 00:00:00", "same start twice"),
    (5, "2030-06-01 08:00:00", "end of time"),
]
VERSIONS = [
    (1, "2024-01-01", "2024-03-31", 10, "a"),
    (1, "2024-02-01", "2024-02-29", 20, "b"),
    (2, "2024-01-01", None, 30, "c"),
    (4, "2024-05-01", "2024-05-31", 40, "d"),
    (4, "2024-05-01", "2024-06-30", 5, "e"),
    (5, "2020-01-01", "9999-12-31", 50, "f"),
    (5, "2031-01-01", "2030-01-01", 60, "never"),
]


@pytest.fixture(
    params=[(1000, 1000), (0, 1000), (0, 1)],
    ids=["broadcast", "shuffled", "salted"],
)
def match(request, spark, monkeypatch):
    broadcast, hot = request.param
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    spark.conf.set(HOT_ROWS_CONF, str(hot))
    request.addfinalizer(lambda: spark.conf.unset(HOT_ROWS_CONF))
    facts = spark.createDataFrame(FACTS, "k int, at string, label string").selectExpr(
        "k", "cast(at as timestamp_ntz) at", "label"
    )
    versions = spark.createDataFrame(
        VERSIONS, "k int, s string, e string, value int, name string"
    ).selectExpr("k", "cast(s as date) start_date", "cast(e as date) end_date", "value", "name")

    def run(prefer, facts=facts, versions=versions, **more):
        found = interval_match_best(
            facts, versions, key="k", at="at", prefer=prefer, take={"name": "name"}, **more
        )
        return {r.label: r.name for r in found.collect()}

    run.facts, run.versions = facts, versions
    return run


COMMON = {
    "at the start": "a", "at the end": "a", "just after": None, "just before": None,
    "open end": None, "no versions": None, "no key": None, "end of time": "f",
}


def test_prefers_the_latest_end(match):
    assert match(["end_date"]) == {**COMMON, "two cover": "a", "same start twice": "e"}


def test_prefers_the_latest_start(match):
    found = match(["start_date", "end_date"])
    assert found == {**COMMON, "two cover": "b", "same start twice": "e"}


def test_prefers_the_highest_attribute(match):
    assert match(["value"]) == {**COMMON, "two cover": "b", "same start twice": "d"}


def test_keeps_every_fact_once(match, spark):
    found = interval_match_best(
        match.facts, match.versions, key="k", at="at", prefer=["end_date"], take={"name": "n"}
    )
    assert found.columns == ["k", "at", "label", "n"]
    assert found.count() == len(FACTS)
    twice = match.facts.union(match.facts)
    assert interval_match_best(
        twice, match.versions, key="k", at="at", prefer=["end_date"], take={"name": "n"}
    ).count() == 2 * len(FACTS)


def test_fact_id_keeps_the_preferred_match(match, spark):
    facts = spark.sql(
        "select * from values (1, timestamp_ntz'2024-05-05', 'x', 7),"
        " (1, timestamp_ntz'2024-01-05', 'y', 7), (9, timestamp_ntz'2024-01-05', 'z', 8)"
        " as t(k, at, label, id)"
    )
    found = match(["end_date"], facts=facts, fact_id=["id"], fact_order=["label"])
    assert found == {"y": "a", "z": None}


def test_date_facts(match, spark):
    facts = match.facts.selectExpr("k", "cast(at as date) at", "label")
    found = match(["end_date"], facts=facts)
    assert found["at the end"] == found["just after"] == "a"


def test_no_facts(match):
    assert match(["end_date"], facts=match.facts.limit(0)) == {}


def plain_match(spark, facts, versions, prefer):
    """A join on the interval and a maximum."""
    facts.createOrReplaceTempView("f_")
    versions.createOrReplaceTempView("v_")
    order = ", ".join(f"v_.{c}" for c in prefer)
    return spark.sql(
        f"select f_.*, b.name from f_ left join (select f, max(struct({order}, name)).name name"
        " from f_ join v_ on f_.k = v_.k and at between start_date and end_date group by f) b"
        " using (f)"
    )


@pytest.mark.parametrize("prefer", [["end_date", "id"], ["start_date", "id"], ["worth", "id"]])
def test_many_versions_of_one_key(spark, prefer):
    versions = spark.sql(
        "select 1 k, date_add(date'2024-01-01', cast(id * 7 % 365 as int)) start_date,"
        " date_add(date'2024-01-01', cast(id * 7 % 365 + id % 50 as int)) end_date,"
        " cast(id as string) name, id, id * 7919 % 101 worth from range(600)"
    )
    facts = spark.sql(
        "select 1 k, timestampadd(HOUR, cast(id * 5 as int), timestamp_ntz'2023-12-20') at, id f"
        " from range(1900)"
    )
    found = interval_match_best(
        facts, versions, key="k", at="at", prefer=prefer, take={"name": "name"}
    ).select("f", "k", "at", "name")
    plain = plain_match(spark, facts, versions, prefer).select("f", "k", "at", "name")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


@pytest.mark.parametrize("prefer", [["start_date", "id"], ["worth", "id"]])
def test_ten_thousand_nested_versions_of_one_key(spark, prefer):
    """Nested over 27 years, so that thousands cover a fact; one ends never."""
    versions = spark.sql(
        "select 1 k, date_add(date'1990-01-01', cast(id div 2 as int)) start_date,"
        " if(id = 0, date'9999-12-31', date_sub(date'2020-01-01', cast((id + 1) div 2 as int)))"
        " end_date, cast(id as string) name, id, id * 7919 % 10007 worth from range(10000)"
    )
    facts = spark.sql(
        "select 1 k, timestampadd(HOUR, cast(id * 1501 as int), timestamp_ntz'1989-12-20') at,"
        " id f from range(240)"
    )
    found = interval_match_best(
        facts, versions, key="k", at="at", prefer=prefer, take={"name": "name"}
    ).select("f", "k", "at", "name")
    plain = plain_match(spark, facts, versions, prefer).select("f", "k", "at", "name")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_segments_do_not_overlap_and_stay_few(spark):
    spans = spark.sql(
        "select 1 _span_key, cast(a.id as int) `from`, cast(b.id as int) until,"
        " struct(hash(a.id, b.id) p0) best from range(0, 512, 2) a join range(0, 512, 2) b"
        " on a.id <= b.id lateral view explode(array(1, 2, 3)) t as n"
    )
    (row,) = validity.segments(spans).collect()
    assert spans.count() == 3 * 32896 and len(row["from"]) == len(row.best) <= 513
    assert row["from"] == sorted(set(row["from"]))
    held = {(r["from"], r.until): r.best.p0 for r in spans.distinct().collect()}
    for place, best in list(zip(row["from"], row.best))[::16]:
        covering = [v for (s, e), v in held.items() if s <= place <= e]
        assert (best and best.p0) == max(covering, default=None)


def test_several_version_tables_by_one_join(spark, capsys):
    """Two tables at once give what two matches give, with one lookup of the facts."""
    first = spark.sql(
        "select id % 7 k, date_add(date'2024-01-01', cast(id * 3 % 200 as int)) start_date,"
        " date_add(date'2024-01-01', cast(id * 3 % 200 + id % 9 as int)) end_date, id a"
        " from range(90)"
    )
    second = spark.sql(
        "select id % 5 k, date_add(date'2024-02-01', cast(id * 5 % 150 as int)) start_date,"
        " date_add(date'2024-02-01', cast(id * 5 % 150 + id % 40 as int)) end_date, id b"
        " from range(60)"
    )
    facts = spark.sql(
        "select id % 9 k, timestampadd(HOUR, cast(id * 7 as int), timestamp_ntz'2023-12-30') at,"
        " id f from range(700)"
    )
    found = validity.interval_match_all(
        facts,
        [validity.Versions(first, ["a"], {"a": "a"}), validity.Versions(second, ["b"], {"b": "b"})],
        key="k", at="at",
    )
    one = interval_match_best(facts, first, key="k", at="at", prefer=["a"], take={"a": "a"})
    both = interval_match_best(one, second, key="k", at="at", prefer=["b"], take={"b": "b"})
    assert found.columns == both.columns
    assert found.exceptAll(both).isEmpty() and both.exceptAll(found).isEmpty()
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") == 1


def test_bounds_must_be_dates(spark):
    df = spark.sql("select 1 k, timestamp_ntz'2024-01-01' start_date, date'2024-01-01' end_date")
    with pytest.raises(TypeError):
        interval_match_best(
            df.withColumnRenamed("start_date", "at"), df, key="k", at="at",
            prefer=["end_date"], take={},
        )


def test_keep_latest(spark):
    df = spark.sql("select * from values (1, 5, 'a'), (1, 7, 'b'), (1, 7, 'c'), (2, null, 'd')"
                   " as t(k, v, n)")
    kept = keep_latest(df, ["k"], ["-v", "n"])
    assert {(r.k, r.n) for r in kept.collect()} == {(1, "b"), (2, "d")}
