"""Exact top-k inner products by a pivot-distance index.

Inner products become distances by one more component. Vectors fall into bands by norm, with M the greatest squared norm
of a band; v' = (v, sqrt(M - |v|^2)), q' = (q, 0) and pivots (p, 0), so |q' - v'|^2 = |q|^2 + M - 2 q.v: the nearest of
a band are those with the highest scores, and the added component is small within a band. Each vector is keyed by its
band, its nearest pivot and its distance from it; the sorted keys are cut into annuli of bounded size, blocks of the
index, and of each annulus the least and the greatest distance from each of REFS pivots are kept. A query first meets the
annuli that may be nearest, until these hold k others; the k-th score bounds what can still get in. By the triangle inequality
|q' - v'| >= |d(q', p) - d(v', p)| for every pivot, so an annulus whose distances from any of them are farther off than
the bound is left out, and the rest are expanded. Results are exact: a bound only ever leaves out vectors whose score is
below the k-th, with a margin for rounding.

Pivots are chosen far from one another from a bounded sample (SAMPLE rows of least hash), the origin first; they affect
speed alone. How much is left out depends on the vectors: of clustered ones most, of random directions in many
dimensions next to nothing, whatever the index (see the README). A hot cell is many annuli, and many tasks. Annuli number
MAX_BLOCKS + bands * pivots + partitions at most, whatever the input, so their bounds are broadcast. Annuli are joined by
strips of STRIP, and queries by packs of PACK, both as small whole numbers where they are such: so what is shuffled is the
queries times the strips they meet. A task holds one pack and one strip, CELLS scores, and BATCH bytes of packs at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

K = 20
PIVOTS = 64
REFS = 16  # pivots of which an annulus keeps bounds
SAMPLE = 2048
BLOCK = 1024
MAX_BLOCKS = 1 << 16
CELLS = 1 << 19
STRIP = 16  # annuli that are stored and joined as one row
PACK = 2048  # queries that meet a strip as one row
BATCH = 8 << 20  # bytes of packs that a task hands over at once
_STRIPS = "strip long, bands array<int>, sizes array<long>, low binary, high binary, ids binary, vectors binary"


def quantize(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<double>): floor(64 x); vectors that are null or hold null or non-finite
    components, or have no id, are left out."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.select("vec_id", "embedding").filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("double")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin, and of a sample up to n - 1 rows each as far as can be from those before it."""
    out = [np.zeros(sample.shape[1])]
    gap = (sample * sample).sum(1)
    while len(out) < n and len(gap) and gap.max() > 0:
        out.append(sample[gap.argmax()])
        gap = np.minimum(gap, ((sample - out[-1]) ** 2).sum(1))
    return np.array(out)


def _apart(v: np.ndarray, tops: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of extended vectors from the pivots, by rows; tops: the M of each row's band."""
    return np.sqrt(np.maximum(tops[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T, 0))


def _band(v: np.ndarray) -> np.ndarray:
    """Squared norms within a factor of the square root of 2 are a band."""
    return np.floor(2 * np.log2(np.maximum((v * v).sum(1), 0.25))).astype(np.int32)


def _keyed(pivots: np.ndarray, top: dict[int, float]):
    """(vec_id, v) -> band, nearest pivot and distance from it."""

    def run(it):
        for batch in it:
            v = _matrix(batch.column(1), pivots.shape[1])
            band = _band(v)
            d = _apart(v, np.array([top[b] for b in band.tolist()]), pivots)
            near = d.argmin(1) if len(v) else np.zeros(0, int)
            yield pa.record_batch([batch.column(0), pa.array(band), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "band", "pivot", "dist", "v"])

    return run


def _banded(it):
    for batch in it:
        v = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
        yield pa.record_batch([pa.array(_band(v)), pa.array((v * v).sum(1))], names=["band", "norm2"])


def _cut(block: int, pivots: np.ndarray, top: dict[int, float], kind: type):
    """Rows of a partition sorted by (band, pivot, dist) -> strips of annuli, which are of one band and pivot and block rows at
    most: STRIP annuli to a strip, and no more rows than STRIP * BLOCK or one annulus."""

    def run(it):
        from pyspark import TaskContext

        base, n, held, key, strip = TaskContext.get().partitionId() << 32, 0, [], None, []

        def annulus():
            ids, vecs = zip(*held)
            held.clear()
            v = np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
            d = _apart(v, np.full(len(vecs), top[key[0]]), pivots[:REFS])
            strip.append((key[0], len(ids), d.min(0), d.max(0), np.array(ids, np.int64), v.astype(kind)))

        def flush():
            nonlocal n
            n += 1
            bands, sizes, *rest = zip(*strip)
            strip.clear()
            return pa.record_batch([pa.array([base + n]), pa.array([list(bands)], pa.list_(pa.int32())), pa.array([list(sizes)], pa.list_(pa.int64())), *(pa.array([np.concatenate(x).tobytes()]) for x in rest)], names=[x.split()[0] for x in _STRIPS.split(", ")])

        for batch in it:
            for vec_id, b, p, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "band", "pivot", "v"))):
                if held and ((b, p) != key or len(held) == block):
                    annulus()
                    if len(strip) == STRIP or sum(x[1] for x in strip) + block > STRIP * BLOCK:
                        yield flush()
                key = b, p
                held.append((vec_id, v))
        if held:
            annulus()
        if strip:
            yield flush()

    return run


def _route(pivots: np.ndarray, shared, k: int, first: bool, kind: type):
    """Queries -> packs for each strip they must meet: (strip, qids, vectors, floors, bits of the annuli to meet, their number).
    first: the annuli that may be nearest and hold k others; later: all within reach of the query's k-th score, but those.
    shared: a broadcast of bounds. What a task holds is PACK queries by annuli in bits, and CELLS of them in numbers."""

    def meets(batch, bounds, q):
        """Of each query and annulus, whether they must meet."""
        top, rows = bounds["top"], bounds["n"]
        norm = (q * q).sum(1)
        d = np.sqrt(np.maximum(norm[:, None] + (pivots[:REFS] ** 2).sum(1)[None] - 2 * q @ pivots[:REFS].T, 0))
        least = np.zeros((len(q), len(rows)))
        for r in range(d.shape[1]):
            np.maximum(least, bounds["low"][None, :, r] - d[:, r, None], out=least)
            np.maximum(least, d[:, r, None] - bounds["high"][None, :, r], out=least)
        # the best score that an annulus may hold; nearest first means highest first, across bands
        best = (norm[:, None] + top[None] - least * least) / 2
        order = np.argsort(-best, axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        home = np.zeros(least.shape, bool)
        np.put_along_axis(home, order, before < k + 1, axis=1)
        if first:
            return home
        floor = batch.column("floor").to_numpy(zero_copy_only=False)
        square = norm[:, None] + top[None] - 2 * floor[:, None]
        possible = square >= -1e-6 * (1 + norm[:, None] + top[None])
        return (least <= np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6) & possible & ~home

    def run(it):
        bounds = shared.value
        step = max(1, CELLS // max(1, len(bounds["n"])))
        names = ["strip", "qids", "qs", "floors", "bits", "met"]
        for whole in it:
            for start in range(0, whole.num_rows, PACK):
                batch = whole.slice(start, PACK)
                ids = batch.column("vec_id").to_numpy()
                q = _matrix(batch.column("v"), pivots.shape[1])
                floor = np.full(len(q), -np.inf) if first else batch.column("floor").to_numpy(zero_copy_only=False)
                bits = np.concatenate([np.packbits(meets(batch.slice(s, step), bounds, q[s : s + step]), axis=1) for s in range(0, len(q), step)])
                q, out, held = q.astype(kind), [], 0
                for strip, a, b in zip(bounds["strip"], bounds["from"], bounds["to"]):
                    own = np.unpackbits(bits[:, a // 8 : -(-b // 8)], axis=1)[:, a % 8 : a % 8 + b - a]
                    at = np.flatnonzero(own.any(1))
                    if not len(at):
                        continue
                    out.append((int(strip), ids[at].tobytes(), q[at].tobytes(), floor[at].tobytes(), np.packbits(own[at], axis=1).tobytes(), int(own[at].sum(dtype=np.int64))))
                    held += sum(map(len, out[-1][1:5]))
                    if held > BATCH:
                        yield pa.record_batch([pa.array(x) for x in zip(*out)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(x) for x in zip(*out)], names=names)

    return run


def _score(dim: int, k: int, number: type, kinds: tuple[type, type]):
    """Packs joined to their strips -> each query's k best of the annuli that it meets there, of those that reach its floor.
    number: a type in which the products are exact; kinds: those in which vectors and queries are stored."""

    def run(it):
        for batch in it:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: E731, B023
                qids, floor, sizes = get("qids", np.int64), get("floors", np.float64).copy(), np.array(batch.column("sizes")[row].as_py())
                q, bits = get("qs", kinds[1]).reshape(-1, dim).astype(number), np.unpackbits(get("bits", np.uint8).reshape(len(qids), -1), axis=1)
                ids, v, ends, out = get("ids", np.int64), get("vectors", kinds[0]).reshape(-1, dim), np.cumsum(sizes), []
                for j, (size, end) in enumerate(zip(sizes, ends)):
                    there = ids[end - size : end]
                    order = np.argsort(there, kind="stable")
                    there, w = there[order], v[end - size : end][order].astype(number).T
                    met = np.flatnonzero(bits[:, j])
                    few = max(1, CELLS // (2 * len(there)))
                    for at in (met[x : x + few] for x in range(0, len(met), few)):
                        s = q[at] @ w
                        ok = s >= floor[at, None].astype(s.dtype if s.dtype != np.int64 else np.float64)
                        own, past = np.searchsorted(there, qids[at]), np.searchsorted(there, qids[at], "right")
                        for i in np.flatnonzero(past > own):
                            ok[i, own[i] : past[i]] = False
                        i, c = np.divmod(np.flatnonzero(ok), len(there))
                        many = np.flatnonzero(np.bincount(i, minlength=len(at)) > k)
                        if len(many):  # only the k best of these, whose k-th is the floor from here on
                            part = np.where(ok[many], s[many], np.iinfo(np.int64).min + 1 if s.dtype == np.int64 else -np.inf)
                            best = _best(part, k)
                            floor[at[many]] = np.take_along_axis(part, best, 1)[:, -1]
                            ok[many] = False
                            ok[many[:, None], best] = True
                            i, c = np.divmod(np.flatnonzero(ok), len(there))
                        out.append((at[i], there[c], s[i, c].astype(np.int64)))
                if not out:
                    continue
                i, c, s = (np.concatenate(x) for x in zip(*out))
                order = np.lexsort((c, -s, i))
                i, c, s = i[order], c[order], s[order]
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
                keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < k
                yield pa.record_batch([pa.array(x[keep]) for x in (qids[i], c, s)], names=["query_id", "vec_id", "score"])

    return run


def _kind(top: float) -> type:
    """The least type that holds the whole components of vectors whose squared norms are top at most."""
    return next((t for t in (np.int8, np.int16, np.int32) if top <= float(np.iinfo(t).max) ** 2), np.float64)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k greatest, ties to the smaller index: what equals the k-th is told apart by index."""
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
    out = np.empty((len(s), k), np.int64)
    for i, row in enumerate(s):
        idx = np.flatnonzero(row >= kth[i])
        out[i] = idx[np.argsort(-row[idx], kind="stable")[:k]]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each (vec_id, v) of queries the k highest inner products with other rows
    of vectors, ties to the smaller vec_id. v: whole numbers as doubles, of one dimension (others raise an error).

    Rows that share a vec_id are each a candidate, and as queries one: its ranks go over the scores of all its rows, so a
    candidate may come once for each. A query's own id is no candidate. Empty tables give an empty result.
    report is filled with the number of annuli and the share of (query, annulus) that were met.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    vectors = ws.save(vectors, "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    stat = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("top"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not stat.n:
        return spark.createDataFrame([], schema)
    if stat.least != stat.most:
        raise ValueError("vectors differ in dimension")
    dim = stat.most
    queries = ws.save(queries, "queries")
    asked = queries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("top"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if asked.top is None:
        return spark.createDataFrame([], schema)
    if (asked.least, asked.most) != (dim, dim):
        raise ValueError("queries and vectors differ in dimension")
    # a sum of products stays below the product of the norms, and is exact in a type that holds as large whole numbers
    reach = math.sqrt(stat.top) * math.sqrt(asked.top)
    number = np.float32 if reach < 1 << 23 else np.float64 if reach < 1 << 52 else np.int64
    kinds = _kind(stat.top), _kind(asked.top)
    top = {r.band: r.top for r in vectors.select("v").mapInArrow(_banded, "band int, norm2 double").groupBy("band").agg(F.max("norm2").alias("top")).collect()}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()
    pivots = spread(np.array([r.v for r in sample], np.float64).reshape(-1, dim), PIVOTS)
    block = max(BLOCK, math.ceil(stat.n / MAX_BLOCKS))
    keyed = vectors.mapInArrow(_keyed(pivots, top), "vec_id long, band int, pivot int, dist double, v binary")
    order = ["band", "pivot", "dist", "vec_id"]
    index = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(block, pivots, top, kinds[0]), _STRIPS)
    index = ws.save(index, "index")
    rows = index.select("strip", "bands", "sizes", "low", "high").orderBy("strip").collect()  # see the module's note on their number
    ends = np.cumsum([len(r.bands) for r in rows])
    bounds = {"strip": np.array([r.strip for r in rows]), "from": ends - [len(r.bands) for r in rows], "to": ends}
    bounds |= {"n": np.array([n for r in rows for n in r.sizes]), "top": np.array([top[b] for r in rows for b in r.bands])}
    bounds |= {c: np.concatenate([np.frombuffer(r[c]).reshape(len(r.bands), -1) for r in rows]) for c in ("low", "high")}
    shared = spark.sparkContext.broadcast(bounds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = []
    # by number, since what a strip costs is its scores: joined partitions are not to be united for their few bytes
    parts = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def meet(routed: DataFrame, first: bool) -> DataFrame:
        packs = routed.mapInArrow(_route(pivots, shared, k, first, kinds[1]), "strip long, qids binary, qs binary, floors binary, bits binary, met long")
        if report is not None:
            packs = ws.save(packs, f"packs-{first}")
            met.append(packs.agg(F.sum("met")).first()[0] or 0)
        strips = index.select("strip", "sizes", "ids", "vectors").repartition(parts, "strip")
        both = packs.repartition(parts, "strip").join(strips.hint("merge"), "strip")
        return both.mapInArrow(_score(dim, k, number, kinds), "query_id long, vec_id long, score long")

    near = ws.save(meet(queries, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "near")
    floors = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    reaching = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "v", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor"))
    found = near.unionByName(meet(reaching, False)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if report is not None:
        report |= {"annuli": len(bounds["n"]), "met": sum(met) / max(1, len(bounds["n"]) * queries.count())}
    return found.select("query_id", "rank", "vec_id", "score")


def op2_pivot_topk(spark, sf_dir):
    vectors = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
