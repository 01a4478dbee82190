"""Exact cosine top-k. One query: an expression and TakeOrdered. Many: a block kernel over Arrow batches, or expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cinderfind.functions import vectors as V
from cinderfind.operators.fusion import top

MAX_QUERIES = 4096  # of one broadcast block


def topk(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows most like the query, with score; ties to the smaller key. k below 1: no rows. Filters come first."""
    if where is not None:
        vectors = vectors.filter(where)
    if k < 1:
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", V.cosine(F.col(vector), q)).orderBy(F.desc("score"), key).limit(k)


def scores(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(query_id, id, score) of every query (query_id, vector) and row, in expressions. The queries are crossed with the
    vectors in a broadcast loop; more than MAX_QUERIES are parted by hash into blocks of about so many, each with a loop
    of its own."""
    blocks = -(-queries.count() // MAX_QUERIES)
    q = queries.select("query_id", V.unit(F.col("vector")).alias("_q"))
    v = vectors.select(F.col(key).alias("id"), V.unit(F.col(vector)).alias("_v"))
    parts = [q] if blocks <= 1 else [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [v.crossJoin(F.broadcast(p)).select("query_id", "id", V.clip(V.dot(F.col("_v"), F.col("_q"))).alias("score")) for p in parts])


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(query_id, id, score, rank) for each (query_id, vector) of queries. Ranks come from a per-query group limit."""
    return top(scores(vectors, queries, vector, key), k)


def _packed(rows: DataFrame, key: str, vector: str, most: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of up to most rows: their keys, and their unit vectors one after another."""
    kind, arrow = dict(rows.dtypes)[key], to_arrow_type(rows.schema[key].dataType)

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                m = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, -1)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(arrow)), pa.array([m.tobytes()])], names=list(names))

    return rows.select(key, vector).mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")


def topk_block(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id") -> DataFrame:
    """As topk_batch for many queries: blocks of vectors meet blocks of MAX_QUERIES queries, a matrix product each, of which
    each query's k best stay. Neither side is gathered: a block is a row, and Spark broadcasts the queries' blocks if they
    are small, or else pairs partitions."""
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key]
    if k < 1:
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
    arrow = [to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (vectors, key))]
    n = max(1, -(-queries.count() // MAX_QUERIES))
    asked = _packed(queries.select("query_id", "vector").repartition(n), "query_id", "vector", MAX_QUERIES, ("qids", "qs"))
    met = _packed(vectors, key, vector, 4096, ("ids", "vs")).crossJoin(asked)

    def run(it):
        for batch in it:
            for ids, vs, qids, qs in zip(*(batch.column(c) for c in ("ids", "vs", "qids", "qs"))):
                keys, asking = ids.as_py(), qids.as_py()
                v, q = np.frombuffer(vs.as_buffer()).reshape(len(keys), -1), np.frombuffer(qs.as_buffer()).reshape(len(asking), -1)
                by_key = np.array(sorted(range(len(keys)), key=keys.__getitem__))
                s = np.clip(q @ v[by_key].T, -1, 1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pa.record_batch(
                    [pa.array([i for i in asking for _ in range(best.shape[1])], arrow[0]), pa.array([keys[j] for j in by_key[best].ravel()], arrow[1]), pa.array(np.take_along_axis(s, best, 1).ravel())],
                    names=["query_id", "id", "score"],
                )

    return top(met.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double"), k)
