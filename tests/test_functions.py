import pytest
from pyspark.sql import functions as F

from cinderfind.functions import money, text as T, vectors as V
from cinderfind.model import Scope, Space


def one(spark, column, **row):
    row = row or {"x": 1}
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("v")).first().v


def test_words_and_strip_know_unicode_space(spark):
    s = " a  b\tc　 "
    assert one(spark, T.count_words(F.col("s")), s=s) == 3
    assert one(spark, T.strip(F.col("s")), s=" a b　\n") == "a b"
    assert one(spark, T.tail_words(F.col("s"), 2), s="one two  three") == "two three"
    assert one(spark, T.tail_words(F.col("s"), 5), s="one two") == "one two"


def test_lines_like_splitlines(spark):
    for s in ["a\nb\r\nc\rd", "a\n", "a\n\n", "x y\x0bz", "plain"]:
        assert one(spark, T.lines(F.col("s")), s=s) == s.splitlines()


def test_tokens(spark):
    s = "Héllo ERR_CONNECTION_RESET INC-1104 v1.2 naïve Straße x²"
    assert one(spark, T.tokens(F.col("s"), fold=True), s=s) == ["hello", "err", "connection", "reset", "inc", "1104", "v1", "2", "naive", "straße", "x²"]


def test_projection_keeps_order_and_needs_text(spark):
    f = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in [("Title", " A "), ("Body", " "), ("Notes", "n")]])
    assert one(spark, T.semantic_projection(f)) == "Title: A\nNotes: n"
    with pytest.raises(Exception, match="no text to index"):
        one(spark, T.semantic_projection(F.array(F.struct(F.lit("a").alias("label"), F.lit(" ").alias("value")))))


def test_chunk_ids_and_tokens(spark):
    assert one(spark, T.chunk_id(F.lit("d"), F.lit(12345))) == "d::chunk-12345"
    assert [one(spark, T.estimate_tokens(F.col("s")), s=s) for s in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]


def test_spaces(spark):
    s = Space("Open AI", "text-embedding-3", 64, "v1")
    assert s.space_id == "open_ai__text_embedding_3__64__v1"
    assert one(spark, T.space_id(F.lit("Open AI"), F.lit("text-embedding-3"), F.lit(64), F.lit("v1"))) == s.space_id
    for bad in (("", "m", 3), ("p", "--", 3), ("p", "m", 0), ("p", "m", True)):
        with pytest.raises(ValueError):
            Space(*bad)


def test_scope_checks():
    assert Scope().open and not Scope("t").open
    for bad in ({"tenant_id": " "}, {"visibility": ()}, {"visibility": ("",)}):
        with pytest.raises(ValueError):
            Scope(**bad)


def test_vectors(spark):
    a = F.array(*map(F.lit, (3.0, 4.0)))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, V.unit(zero)) == [0.0, 0.0]
    assert one(spark, V.cosine(a, zero)) == 0.0
    assert one(spark, V.cosine(a, a)) == 1.0
    assert not one(spark, V.sound(F.array(F.lit(float("nan")), F.lit(1.0)), 2))
    assert not one(spark, V.sound(a, 3))


def test_money(spark):
    assert money.usd_to_nanos("0.0000000001") == 1
    assert money.charge_nanos(7, 20_000_000) == 140
    assert money.charge_nanos(17, 20_000_000) == 340
    for bad in (True, float("nan"), float("inf"), -1, "x", 10**19):
        with pytest.raises(ValueError):
            money.usd_to_nanos(bad)
    assert one(spark, money.charge_nanos_column(F.lit(7), F.lit(20_000_000))) == 140
    assert one(spark, money.charge_nanos_column(F.lit(2**60), F.lit(1_000_001))) == -(-(2**60) * 1_000_001 // 10**6)
    assert one(spark, money.usd_to_nanos_column(F.lit("0.0000000001"))) == 1


def test_l2_normalize_as_its_sql(spark, tmp_path):
    """Signs of zeros, ties at the last place, zero vectors and nulls come out as in SQL."""
    import struct

    import duckdb

    import __spark_entry__ as entry

    vectors = [[1.0, -1e-7, 1e-7, 0.0], [-1.0, 5e-7, -5e-7, 1.5e-6], [0.0] * 4, [-0.0, 3.0, 4.0, -2e-9], None, [1.0, 0.1234565, -0.1234565, 2.5e-6]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    bits = lambda unit: unit and [x if x != x else struct.pack("<d", x) for x in unit]
    want = {i: str(bits(unit)) for i, unit in con.execute(entry.oracle_sql()["l2_normalize"]).fetchall()}
    got = {r.vec_id: str(bits(r.unit)) for r in entry.queries()["l2_normalize"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 6
