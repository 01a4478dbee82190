import pytest
from pyspark.sql import functions as F

from cinderfind.model import Scope
from cinderfind.plans.filters import compile_filter, compile_scope, matches, merge_scope

ROWS = [
    ("1", '{"n": "3", "live": true, "kind": "howto", "level": 3}'),
    ("2", '{"live": true, "kind": "defect", "level": 2.0}'),
    ("3", '{"n": 3, "live": false, "kind": "rule", "level": 1}'),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, meta string")


def ids(rows, where):
    return {r.id for r in rows.filter(compile_filter(where, {"id": (F.col("id"), "text")}, F.parse_json("meta"))).collect()}


@pytest.mark.parametrize(
    "where, want",
    [
        (None, {"1", "2", "3"}),
        ({"kind": "howto"}, set("1")),
        ({"kind": {"$in": ["howto", "defect"]}}, {"1", "2"}),
        ({"level": {"$gt": 1}}, {"1", "2"}),
        ({"level": {"$gte": 2}}, {"1", "2"}),
        ({"level": {"$lt": 2}}, {"3"}),
        ({"level": {"$lte": 2}}, {"2", "3"}),
        ({"level": {"$gt": 1, "$lt": 3}}, {"2"}),
        ({"live": True, "level": {"$gte": 3}}, set("1")),
        ({"live": 1}, set()),
        ({"level": 2}, {"2"}),
        ({"n": 3}, {"3"}),
        ({"n": "3"}, set("1")),
        ({"n": {"$gt": 1}}, {"3"}),
        ({"n": {"$in": [3, "3"]}}, {"1", "3"}),
        ({"missing": "x"}, set()),
        ({"id": {"$gt": "1"}}, {"2", "3"}),
    ],
)
def test_filters(rows, where, want):
    assert ids(rows, where) == want


@pytest.mark.parametrize("where", [{"": 1}, {"a": {}}, {"a": {"$ne": 1}}, {"a": {"$in": []}}, {"a": {"$in": "x"}}, {"id": 1}, {"a": {"$gt": "x"}}, {"a": None}, {"a": float("nan")}])
def test_what_is_refused(rows, where):
    with pytest.raises(ValueError):
        ids(rows, where)


def test_matches_agrees(rows):
    import json

    for where in ({"kind": "rule"}, {"level": {"$gt": 1}}, {"live": 1}, {"n": {"$in": [3]}}):
        assert {i for i, m in ROWS if matches(where, json.loads(m))} == ids(rows, where)


def test_scopes(spark):
    docs = spark.createDataFrame([("a", "acme", "internal"), ("b", "acme", "public"), ("c", None, None), ("d", "globex", "internal")], "id string, tenant_id string, visibility string")
    see = lambda s: {r.id for r in docs.filter(compile_scope(s, F.col("tenant_id"), F.col("visibility"))).collect()}
    assert see(Scope("acme")) == {"a", "b", "c"}
    assert see(Scope("globex")) == {"c", "d"}
    assert see(Scope(visibility=("public",))) == {"b", "c"}
    assert see(Scope()) == see(None) == {"a", "b", "c", "d"}
    where = {"tenant_id": "evil", "x": 1}
    assert merge_scope(where, Scope()) is where
    assert merge_scope(where, Scope("acme", ("public",))) == {"tenant_id": "acme", "x": 1, "visibility": {"$in": ["public"]}}


def test_column_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("k", F.col("id") % 3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(compile_filter({"k": {"$in": [1, 2]}}, {"k": (F.col("k"), "number")})).select("id")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(k, [1,2])]" in plan
