import re

import pytest

from cinderfind.llm import mixing


def brute_targets(sizes):
    """The excess of capped sources is reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, "d": 2, None: 7}, {"x": 3}, {"a": 0, "b": 5}, {"é": 5, "z": 900, "Z": 3, "a": 1, "b": 1, None: 1}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "w " * (1 + i * 7 % 60), f"s{i % 5 if i % 3 else 0}", "c") for i in range(1500)]
    rows += [(9000, None, "s1", "c"), (9001, "", None, "c"), (9002, "a\x0bb\x1cc  d", None, "c"), (None, "x y", "s2", "c"), (9003, "dup dup", "s3", "c"), (9003, "dup dup", "s3", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))  # reruns agree
    sizes = {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.copies <= 3 and r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
        assert abs(r.copies - r.target / r.source_size) < 1 or r.size == 0
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s])
    assert len(got) == len(rows)
    assert {(r.doc_id, r.size) for r in got} >= {(9000, 0), (9001, 0), (9002, 3), (9003, 2), (None, 2)}
    out = mixing.repeat_mixed(df)
    assert out.columns == df.columns
    count, have = {}, {}
    for r in got:
        count[r.doc_id, r.source] = count.get((r.doc_id, r.source), 0) + r.copies
    for r in out.collect():
        have[r.doc_id, r.source] = have.get((r.doc_id, r.source), 0) + 1
    assert have == {k: n for k, n in count.items() if n}


def test_rows_without_ids_or_words(spark):
    """Each row comes back, also of a hot null id, of equal rows, and of a source whose texts are all empty."""
    rows = [(None, f"text {i} of its own", "s1") for i in range(20)] + [(None, "same", "s1")] * 30 + [(1, "", "e"), (2, None, "e"), (3, "one two", "s2"), (4, "w " * 200_000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 50
    assert {r.source: r.target for r in got}["e"] == 0 and all(r.copies == 0 for r in got if r.source == "e")
    same = [r.copies for r in got if r.source == "s1" and r.size == 1]
    assert max(same) - min(same) <= 1
    out = mixing.repeat_mixed(df).collect()
    assert len(out) == sum(r.copies for r in got)
    none = spark.createDataFrame([(1, "", "e"), (None, None, None)], df.schema)
    assert [(r.target, r.copies) for r in mixing.mix(none).collect()] == [(0.0, 0)] * 2 and mixing.repeat_mixed(none).count() == 0


def test_query(spark, tmp_path):
    rows = [(i, "w " * (i % 30), f"s{i % 4}", "en") for i in range(200)] + [(7, "twice", "s1", "en")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, source string, target string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op7_mix_sources(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    got = got.collect()
    assert len(got) == 202 and all(r.taken <= 3 * r.size for r in got)


def test_unbiased():
    import numpy as np

    rng = np.random.default_rng(0)
    p = np.array([0.3, 0.9, 0.5, 0.2, 0.7, 0.45])
    total = np.zeros(len(p))
    for _ in range(4000):
        x = p.copy()
        i = mixing._pivot(x, rng.random(len(p)))
        x[i] = float(rng.random() < x[i])
        total += x
    assert np.allclose(total / 4000, p, atol=0.03)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.repeat_mixed(df).count() == 0
