import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from cinderfind.operators import dense, lexical
from cinderfind.operators.fusion import rrf, top
from cinderfind.plans.analyze import analyze


def fuse(spark, lists, **kw):
    frames = [spark.createDataFrame([(0, x, i) for i, x in enumerate(ids, 1)], "query_id int, id string, position int") for ids in lists]
    return {r.id: r.score for r in rrf(frames, **kw).collect()}


def test_rrf(spark):
    both = fuse(spark, ["ab", "ba"])
    assert both["b"] == both["a"] and math.isclose(both["b"], sum(1 / (60 + i) for i in (1, 2)))
    assert fuse(spark, [["a", "a", "b"]]) == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 63)}
    assert fuse(spark, [["a"], ["b"]], weights=[2.0, 1.0])["a"] == pytest.approx(2 / 61)
    for kw in ({"k": 0}, {"weights": [1.0, -1.0]}, {"weights": [1.0]}):
        with pytest.raises(ValueError):
            fuse(spark, [["a"], ["b"]], **kw)
    with pytest.raises(Exception, match="empty"):
        fuse(spark, [[""]])


def test_top_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(0, x, 1.0) for x in "dbca"], "query_id int, id string, score double")
    assert [r.id for r in top(df, 2).orderBy("rank").collect()] == ["a", "b"]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("alpha", [1.0, 0.0, 0.0], 3), ("beta", [0.8, 0.6, 0.0], 2), ("gamma", [0.0, 1.0, 0.0], 1), ("zero", [0.0, 0.0, 0.0], 0), ("also", [1.0, 0.0, 0.0], 9)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, priority int")


def test_dense(spark, vectors):
    assert [r.id for r in dense.topk(vectors, [1, 0, 0], 3).collect()] == ["alpha", "also", "beta"]
    assert [r.id for r in dense.topk(vectors, [1, 0, 0], 2, F.col("priority") < 3).collect()] == ["beta", "gamma"]
    assert dense.topk(vectors, [1, 0, 0], 0).count() == 0
    assert {r.score for r in dense.topk(vectors, [0, 0, 0], 9).collect()} == {0.0}


def test_dense_kernels_agree(spark, vectors):
    q = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.3, 0.9, 0.1])], "query_id string, vector array<double>")
    shape = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert shape(dense.topk_batch(vectors, q, 3)) == shape(dense.topk_block(vectors, q, 3))


def test_dense_batch_answers_every_query(spark, vectors, monkeypatch):
    monkeypatch.setattr(dense, "MAX_QUERIES", 4)
    q = spark.createDataFrame([(i, [1.0, i / 7, 0.5]) for i in range(11)], "query_id int, vector array<double>")
    shape = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    got = shape(dense.topk_batch(vectors, q, 3))
    assert len(got) == 33 and got == shape(dense.topk_block(vectors, q, 3))
    assert dense.topk_batch(vectors, q.limit(0), 3).count() == 0


TEXTS = {
    "a": "the certificate rotation failed with INC-1104 and INC-1104", "b": "rotation certificate of the Héllo service", "c": "certificate rotation runbook",
    "d": "1104 inc reversed", "e": "nothing of note", "f": "certificate certificate certificate", "g": "",
}


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build(spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string"))


def found(spark, index, text, units=lexical.plain_units, **kw):
    q = spark.createDataFrame([(0, text)], "query_id int, text string")
    return {r.chunk_id: r.score for r in lexical.search(index, units(q), 10, **kw).collect()}


@pytest.mark.parametrize("query", ["certificate", "certificate rotation", '"certificate rotation"', "certificate certificate", "inc-1104", "the", "nothing"])
def test_bm25_is_fts5s(spark, index, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, tokenize = 'unicode61 remove_diacritics 0')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("INSERT INTO t VALUES (?, ?)", TEXTS.items())
    parts = [m[0] if m[0] else m[1] for m in re.findall(r'"([^"]*)"|(\S+)', query)]
    match = " ".join(f'"{p}"' for p in parts)
    want = {i: -s for i, s in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = found(spark, index, query)
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert math.isclose(v, want[k], rel_tol=1e-9, abs_tol=1e-12)


def test_lexical_dialects(spark, index):
    assert found(spark, index, '"rotation certificate"').keys() == {"b"}
    assert found(spark, index, "INC-1104").keys() == {"a"}
    assert found(spark, index, "-- certificate").keys() == {"a", "b", "c", "f"}
    assert found(spark, index, "--") == {}
    assert found(spark, index, "certificate -rotation or nothing", lexical.websearch_units, bounded=True).keys() == {"f", "e"}
    assert found(spark, index, 'rotation Rotation "certificate rotation"', lexical.contains_units).keys() == {"a", "c"}
    ok = spark.createDataFrame([("c",)], "chunk_id string")
    assert found(spark, index, "certificate", eligible=ok)["c"] == found(spark, index, "certificate")["c"]
    with pytest.raises(Exception, match="blank"):
        found(spark, index, "  ")


def test_missing_index(spark, tmp_path):
    with pytest.raises(lexical.LexicalUnavailable):
        lexical.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "text, kind, ids",
    [
        ("INC-1104", "identifier", ["INC-1104"]), ("see CHG-2407 and CHG-2407", "identifier", ["CHG-2407"]), ("SQLSTATE 23505 INC-1", "identifier", ["INC-1", "SQLSTATE 23505"]),
        ("ERR_CONNECTION_RESET", "identifier", ["ERR_CONNECTION_RESET"]), ('say "a b"', "phrase", []), ("inc-1104", "natural", []), ("  ", "empty", []),
    ],
)
def test_analyze(spark, text, kind, ids):
    row = analyze(spark.createDataFrame([(text,)], "text string"), lexical_boost=3.0).first()
    assert (row.kind, row.identifiers) == (kind, ids)
    assert row.lexical_weight == (3.0 if kind in ("identifier", "phrase") else 1.0)
    with pytest.raises(ValueError):
        analyze(spark.createDataFrame([(text,)], "text string"), lexical_boost=0)


def test_a_written_index_is_pruned(spark, index, tmp_path):
    lexical.write(index, str(tmp_path / "i"), 2)
    units = lexical.plain_units(spark.createDataFrame([(0, "certificate rotation")], "query_id int, text string"))
    small = lexical.pruned(lexical.read(spark, str(tmp_path / "i")), units)
    assert "In(term" in small.postings._jdf.queryExecution().toString()
    key = lambda df: sorted((r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(lexical.score(small, units)) == key(lexical.score(index, units))
