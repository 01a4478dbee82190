import types

import numpy as np
import pyarrow as pa
import pytest

from cinderfind.llm import topk


def brute(rows, k):
    v = {i: np.floor(np.asarray(x, float) * 64).astype(int) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = set()
    for q in v:
        if q % 20 == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PIVOTS", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * scale
    x[50:120] = x[50]  # ties: many equal vectors
    x[130] = 0
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(x)]
    rows += [(400, None), (420, [1.0] * 7 + [None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8)]
    df = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(r) for r in topk.search(df, df.filter("vec_id % 20 = 0"), 20).collect()}
    assert got == brute(rows, 20)


def test_norms_and_clusters(spark, monkeypatch):
    """Norms of a hundredfold range, exact; of clustered vectors less than half of the annuli are met."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CELLS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6)) * 10 ** rng.uniform(-1, 1, (240, 1))
    df = topk.quantize(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in topk.search(df, df.filter("vec_id % 20 = 0")).collect()} == brute([(i, r) for i, r in enumerate(x)], 20)
    centres = rng.normal(size=(12, 32))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 60, axis=0) + rng.normal(size=(720, 32)) * 0.02
    df = topk.quantize(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    report = {}
    got = {tuple(r) for r in topk.search(df, df.filter("vec_id % 20 = 0"), report=report).collect()}
    assert got == brute([(i, r) for i, r in enumerate(x)], 20) and report["met"] < 0.5


def test_repeated_ids(spark, tmp_path):
    """Each row is a candidate; as a query the rows of an id share its ranks."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.25, 0.5]), (2, [0.25, 0.25])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.op2_pivot_topk(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 2048), (2, 1, 2048), (3, 1, 1024), (4, 1, 1024), (5, 2, 1024), (6, 2, 1024)]


def test_few_and_none(spark):
    df = topk.quantize(spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "y")], "vec_id long, embedding array<float>, score string"))
    assert [tuple(r) for r in topk.search(df, df, 20).orderBy("query_id").collect()] == [(0, 1, 1, 2048), (1, 1, 0, 2048)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df, df.limit(0)).count() == 0
    mixed = topk.quantize(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        topk.search(mixed, mixed)


def test_what_a_task_hands_over_is_bounded():
    """Queries that meet every annulus: batches of a bounded size, and each query once a strip, not once an annulus."""
    n, strips, dim = 4096, 60, 64
    a = strips * topk.STRIP
    ends = np.arange(1, strips + 1) * topk.STRIP
    bounds = {"strip": np.arange(strips), "from": ends - topk.STRIP, "to": ends, "n": np.full(a, 1024), "top": np.full(a, 4096.0), "low": np.zeros((a, 1)), "high": np.full((a, 1), 1e9)}
    q = np.random.default_rng(4).integers(-30, 30, (n, dim)).astype(float)
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(list(q)), pa.array(np.full(n, -1e9))], names=["vec_id", "v", "floor"])
    sizes, met = [], 0
    for out in topk._route(np.zeros((1, dim)), types.SimpleNamespace(value=bounds), 20, False, np.int8)(iter([batch])):
        sizes.append(out.nbytes)
        met += sum(out.column("met").to_pylist())
    assert met == n * (a - 1)  # one annulus holds k others, and was met first
    assert max(sizes) < 2 * topk.BATCH and sum(sizes) < n * strips * (dim + 8 + 8 + 4)


def test_scores_of_a_strip(spark, monkeypatch):
    """Several strips, annuli that some queries of a pack meet and others don't, ties beyond k in one annulus."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "STRIP", 3)
    monkeypatch.setattr(topk, "PACK", 5)
    monkeypatch.setattr(topk, "BATCH", 100)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 3)), np.tile(rng.normal(size=(1, 3)), (60, 1))]) * 300  # norms beyond a byte
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in topk.search(df, df.filter("vec_id % 20 = 0"), 4).collect()} == brute(rows, 4)
