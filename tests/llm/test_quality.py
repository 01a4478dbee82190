import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cinderfind.llm import quality as Q


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "ver", "an", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 80))]
        good = int(rng.random() < 0.8)
        if not good:
            words = [[w.upper() + "!!" for w in words], [w + rng.choice(["***", "$$$"]) for w in words], [w for w in words for _ in range(5)]][i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, good))
    return rows, labels


def test_held_out_accuracy_and_rule(spark):
    rows, labels = corpus()
    rows += [(9001, None), (9002, ""), (9003, "x" * 200_000), (None, "ka to")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(9001, None), (1, 1)], "doc_id long, quality int")
    model = Q.fit(df, lab)
    out = Q.score(df, model).select("doc_id", "score", Q.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    truth = dict(labels)
    held = [(r.score >= 0.3) == truth[r.doc_id] for r in out if r.held and r.doc_id in truth]
    assert len(held) > 80 and sum(held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in out}
    assert by[9001] == by[9002]


def test_order_of_rows_does_not_matter(spark):
    rows, labels = corpus(200)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = Q.fit(df, lab), Q.fit(df.repartition(5).orderBy("text"), lab)
    probe = [Q.features(t, np.zeros(Q.BUCKETS, np.uint8)) for _, t in rows[:40]]
    assert np.allclose([a.score(f) for f in probe], [b.score(f) for f in probe], atol=0.15)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(df, Q.fit(df, none)).collect()] == [0.5]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert Q.score(df, Q.fit(df, one)).first().score > 0.9
    assert Q.keep_good(df, none).collect() == df.collect()
    assert Q.score(df.limit(0), Q.fit(df.limit(0), none)).count() == 0


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10) + 50 * (i % 2)) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    w, bias = Q.descend(rows, y, np.ones(100), np.ones(200))
    assert all(np.sign(w[r].sum() / len(r) ** 0.5 + bias) == t for r, t in zip(rows, y))


def test_descent_against_a_plain_solver():
    """The dual's optimum by projected gradient on the whole matrix: same objective, weights and margins."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 12))) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    r, cost = rng.normal(size=40), np.where(y == 1, 0.5, 1.0)
    x = np.zeros((60, 41))
    for i, f in enumerate(rows):
        x[i, f], x[i, 40] = r[f] / len(f) ** 0.5, 1
    g = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, rate = np.zeros(60), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - rate * (g @ alpha - 1), 0, cost)
    want = (alpha * y) @ x
    w, bias = Q.descend(rows, y, r, cost, epochs=500)
    primal = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - y * (x @ v))
    got = np.append(w / r, bias)
    assert abs(primal(got) - primal(want)) < 1e-2 * primal(want) and np.allclose(x @ got, x @ want, atol=0.05)


def test_repeated_ids_are_learnt_once(spark):
    rows, labels = corpus(200)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    many = df.union(spark.createDataFrame([rows[3]] * 500, "doc_id long, text string"))
    probe = [Q.features(t, np.zeros(Q.BUCKETS, np.uint8)) for _, t in rows[:20]]
    a, b = Q.fit(df, lab), Q.fit(many, lab)
    assert np.allclose([a.score(f) for f in probe], [b.score(f) for f in probe], atol=0.15)


def test_query(spark, tmp_path):
    rows, labels = corpus(60)
    spark.createDataFrame([(i, t, "s") for i, t in rows] + [(None, None, None)], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op4_quality(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and got.count() == 61
