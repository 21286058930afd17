"""Filters, orders, limits, groups on literal rows."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from strandgrid import QueryError, field, over, sharded
from strandgrid.operators import aggregates as agg

ROWS = "Id int, Normalized double, PeriodId int, NameSearch string, NameSearchS string, GroupBy int, Date timestamp_ntz, Dec decimal(20,4), Big bigint, Data binary, VectorL2 array<float>"


def rows(spark, *dicts):
    names = [x.split(" ")[0] for x in ROWS.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], ROWS)


def some(spark, *triples):
    return over(rows(spark, *[{"Id": i, "Normalized": n, "PeriodId": p} for i, n, p in triples]))


def periods(q):
    return [r[0] for r in q.select("PeriodId").collect()]


def test_not_equal_keeps_negative_rows_and_nulls(spark):
    q = some(spark, (1, -1.2, -5), (2, 2.3, 10), (3, -4.5, -15), (4, None, 7))
    assert sorted(periods(q.where(field("Normalized") != -1.2))) == [-15, 7, 10]
    assert sorted(periods(q.where(field("Normalized") != 2.3))) == [-15, -5, 7]


def test_null_comparisons(spark):
    q = some(spark, (1, None, 5), (2, 2.3, 10), (3, None, 15))
    assert periods(q.where(field("Normalized") != None)) == [10]  # noqa: E711
    assert sorted(periods(q.where(field("Normalized") == None))) == [5, 15]  # noqa: E711
    assert periods(q.where(field("Normalized") < 100.0)) == [10]
    with pytest.raises(QueryError):
        q.where(field("Normalized") > None)


def test_empty_string_is_null(spark):
    q = over(rows(spark, {"Id": 1, "NameSearch": ""}, {"Id": 2, "NameSearch": "x"}))
    for empty in ("", None):
        assert [r[0] for r in q.where(field("NameSearch") == empty).get_ids().collect()] == [1]
        assert [r[0] for r in q.where(field("NameSearch") != empty).get_ids().collect()] == [2]


def test_binary_and_vectors_compare_with_null_only(spark):
    q = over(rows(spark, {"Id": 1, "Data": b"", "VectorL2": [1.0]}, {"Id": 2, "Data": b"x"}))
    assert [r[0] for r in q.where(field("Data") == None).get_ids().collect()] == [1]  # noqa: E711
    assert [r[0] for r in q.where(field("VectorL2") == None).get_ids().collect()] == [2]  # noqa: E711
    for bad in (lambda: field("Data") == b"x", lambda: field("VectorL2") == [1.0]):
        with pytest.raises(QueryError):
            q.where(bad())


def test_between(spark):
    q = some(spark, (1, 1.2, 5), (2, 0.9, 7), (3, 0.5, 10), (4, 4.5, 15))
    assert periods(q.between("Normalized", 0.1, 0.9).order_by("PeriodId")) == [7, 10]
    assert periods(q.between("Normalized", 0.5, 0.9, "from_inclusive")) == [10]
    assert periods(q.between("Normalized", 0.5, 0.9, "to_inclusive")) == [7]
    assert periods(q.between("Normalized", 0.5, 0.9, "both_exclusive")) == []
    assert periods(q.between("Normalized", 9.0, 1.0)) == []
    for low, high in ((None, 1.0), (1.0, None)):
        with pytest.raises(QueryError):
            q.between("Normalized", low, high)


def test_or(spark):
    q = some(spark, (1, 1.2, 5), (2, 2.3, 10), (3, 4.5, 15))
    assert sorted(periods(q.where(field("Normalized") > 3.0).or_().where(field("Normalized") == 2.3))) == [10, 15]
    assert periods(q.where(field("PeriodId") == 5).or_().intersect("PeriodId", [10]).where(field("Normalized") > 2.0)) == [10]
    assert q.where(field("PeriodId") == 5).or_().intersect("PeriodId", range(10, 9000)).count().first()[0] == 3
    with pytest.raises(QueryError):
        q.or_()
    with pytest.raises(QueryError):
        q.where(field("PeriodId") == 5).or_().count()


def test_membership(spark):
    q = over(rows(spark, {"Id": 1, "NameSearch": "ПриВеТ", "PeriodId": 1}, {"Id": 2, "NameSearch": None, "PeriodId": 2}, {"Id": 3, "NameSearch": "b"}), required={"GroupBy"})
    ids = lambda x: sorted(r[0] for r in x.get_ids().collect())
    assert ids(q.intersect("NameSearch", ["привет"])) == [1]
    assert ids(q.intersect("NameSearch", ["B", None])) == [2, 3]
    assert ids(q.intersect("PeriodId", [])) == []
    assert ids(q.intersect("PeriodId", [None])) == [3]
    assert ids(q.intersect("PeriodId", [2, *range(10, 5000)])) == [2]
    assert ids(q.intersect("PeriodId", [None, 2, *range(10, 5000)])) == [2, 3]
    assert ids(q.intersect("NameSearch", spark.createDataFrame([("ПРИВЕТ",), ("ПРИВЕТ",)], "x string"))) == [1]
    with pytest.raises(QueryError):
        q.intersect("GroupBy", [1, None])


def test_rejected_shapes(spark):
    q = some(spark, (1, 1.0, 1))
    bad = [
        lambda: q.where(field("PeriodId") + 1 == 2),
        lambda: q.where(field("PeriodId") == field("Id")),
        lambda: q.where(field("PeriodId") == 1.5),
        lambda: q.where(field("PeriodId") == "1"),
        lambda: q.where(field("PeriodId") == True),  # noqa: E712
        lambda: q.where(field("NameSearch") < "x"),
        lambda: q.where(field("Nothing") == 1),
        lambda: q.where((field("PeriodId") == 1) and (field("Id") == 1)),
        lambda: q.where(True),
        lambda: q.select(F.col("Id") + 1),
        lambda: q.select(),
        lambda: q.skip(1),
        lambda: q.take(1),
        lambda: q.order_by("Id").order_by("PeriodId"),
        lambda: q.order_by("Data"),
        lambda: q.search("PeriodId", "x"),
        lambda: q.group_by("Normalized"),
        lambda: q.group_by("Missing"),
        lambda: q.group_by("GroupBy").select(x=1),
        lambda: q.search_neighbours("VectorL2", [1.0], 0),
        lambda: q.search_neighbours("VectorL2", None, 1),
    ]
    for k, make in enumerate(bad):
        with pytest.raises(QueryError):
            make()
            pytest.fail(f"case {k} is accepted")


def test_types(spark):
    q = over(rows(spark, {"Id": 1, "Date": dt.datetime(2020, 1, 2, 3, 4, 5), "Dec": decimal.Decimal("1.5000"), "Big": -(2**60), "PeriodId": 1}, {"Id": 2, "Date": dt.datetime(2021, 1, 1), "Dec": decimal.Decimal("-2.25"), "Big": 2**60}))
    ids = lambda x: sorted(r[0] for r in x.get_ids().collect())
    assert ids(q.where(field("Date") < dt.datetime(2020, 6, 1))) == [1]
    assert ids(q.where(field("Dec") < decimal.Decimal("0"))) == [2]
    assert ids(q.where(field("Dec") >= 1)) == [1]
    assert ids(q.where(field("Big") < -(2**59))) == [1]
    assert ids(q.where(field("PeriodId") < 2**40)) == [1]
    assert ids(q.between("Date", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), "from_inclusive")) == [1]


def test_order_edges(spark):
    q = some(spark, (1, 1.0, 5), (2, 1.0, 7), (3, 1.0, -10), (4, 1.0, -15))
    assert periods(q.order_by("PeriodId").skip(1).take(2)) == [-10, 5]
    assert periods(q.order_by("PeriodId").take(2).skip(1)) == [-10, 5]
    assert periods(q.order_by_descending("PeriodId").take(3)) == [7, 5, -10]
    assert periods(q.order_by("PeriodId").take(0)) == []
    nulls = some(spark, (1, None, 1), (2, 3.0, 2), (3, -1.0, 3))
    assert periods(nulls.order_by("Normalized")) == [1, 3, 2]
    assert periods(nulls.order_by_descending("Normalized")) == [2, 3, 1]


def test_order_of_strings_ignores_case(spark):
    q = over(rows(spark, *[{"Id": k, "NameSearch": s} for k, s in enumerate(["b", "A", "C", "a"], 1)]))
    assert [r[0] for r in q.order_by("NameSearch").select("Id").collect()] == [2, 4, 1, 3]


def test_groups(spark):
    q = over(rows(spark, *[{"Id": k, "GroupBy": g, "Normalized": n} for k, (g, n) in enumerate([(5, 1.2), (3, 7.0), (10, 2.3), (10, 4.5)], 1)]))
    out = q.group_by("GroupBy").select(k=agg.key(), s=agg.sum_("Normalized"), n=agg.count(), lo=agg.min_("Normalized"), hi=agg.max_("Normalized"), m=agg.average("Normalized"), u=agg.count_distinct("Normalized"))
    assert sorted((r.k, round(r.s, 6), r.n, r.lo, r.hi, round(r.m, 6), r.u) for r in out.collect()) == [(3, 7.0, 1, 7.0, 7.0, 7.0, 1), (5, 1.2, 1, 1.2, 1.2, 1.2, 1), (10, 6.8, 2, 2.3, 4.5, 3.4, 2)]
    some_ = q.where(field("Normalized") > 3.0).group_by("GroupBy").select(k=agg.key(), n=agg.count())
    assert sorted(map(tuple, some_.collect())) == [(3, 1), (10, 1)]
    assert [c for c in q.group_by("GroupBy").select(k=agg.key()).collect()].__len__() == 3
    with pytest.raises(QueryError):
        q.group_by("GroupBy").select(s=agg.sum_("NameSearch"))


def test_builder_is_reusable_and_counts(spark):
    q = some(spark, (1, 1.0, 5), (2, 2.0, 7), (1500, 3.0, 9))
    few = q.where(field("PeriodId") > 5)
    assert q.count().first()[0] == 3 and few.count().first()[0] == 2 and few.count().first()[0] == 2
    assert few.all_ids().first().asDict() == {"n_ids": 2, "all_ids": False}
    assert q.all_ids().first()["all_ids"]
    assert q.last_step().first()[0] == 1
    assert few.order_by("PeriodId").take(1).statistics().first()["total"] == 2
    assert [len(b) for b in q.in_batches("Id", size=2)] == [2, 1]
    assert over(rows(spark)).last_step().first()[0] is None


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, {"Id": 1, "PeriodId": 3}).write.parquet(path)
    plan = over(spark.read.parquet(path)).where(field("PeriodId") != 4).between("Id", 1, 9).select("Id")._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualNullSafe(PeriodId,4))" in plan.replace(" ", "") and "GreaterThanOrEqual(Id,1)" in plan
    assert "NameSearch" not in plan.split("ReadSchema")[1]


def test_sharded(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (2, 1, 7), (2, 2, 1)], "Sid int, Id int, v int")
    q = sharded(df)
    assert [tuple(r) for r in q.order_by("v").take(3).select("Sid", "v").collect()] == [(2, 1), (1, 5), (2, 7)]
    assert sorted(map(tuple, q.intersect_ids(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "Sid int, Id int")).get_ids().collect())) == [(1, 2), (2, 1)]
    with pytest.raises(QueryError):
        q.order_by("v").skip(1)
    with pytest.raises(QueryError):
        q.order_by("v").select("Id")
    with pytest.raises(QueryError):
        q.group_by("v").select(n=agg.count())
