import random
from collections import Counter

import numpy as np
import pytest

from cinderfind.llm import _common, simhash as S


def jaccard(a, b):
    sh = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    a, b = sh(a.lower().split()), sh(b.lower().split())
    return len(a & b) / len(a | b)


def brute(rows):
    ids = [r for r in rows if r[0] is not None]
    root = {i: i for i, _ in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(ids):
        for j, b in ids[:n]:
            if jaccard(a or "", b or "") >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed=1, groups=12, copies=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 150, 400]))]
        for c in range(copies):
            t = list(base)
            for _ in range(c and max(1, len(t) // 150)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "A  b"), (904, "a B"), (None, "a b")]
    rows += [(905, rows[0][1]), (905, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = S.classes(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None and not r.leader for r in got if r.doc_id is None)
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({*want.values(), None})
    assert S.classes(df.limit(0)).count() == 0 and S.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [10, 10**6])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, leaf):
    """Small buckets, blocks and widths: the rounds must still join a large group of different near copies."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, t) for i, t in corpus(3, 6, 3)]
    monkeypatch.setattr(S, "BUCKET", 40)
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "SMALL", 4)
    monkeypatch.setattr(S, "WIDTH", 2)
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bits_tell_similarity():
    rows = corpus(5, 6, 2)
    for a, b in zip(rows[::2], rows[1::2]):
        x, y = S.simhash(S.shingles(a[1])), S.simhash(S.shingles(b[1]))
        if jaccard(a[1], b[1]) >= 0.8:
            assert int((x != y).sum()) <= S.far()
    assert S.shape(2) == S.shape(10**7) and S.shape(2)[0] == S.DEPTH
    for n in (10**8, 10**9):  # a larger corpus: deeper and more tries, the same recall
        k, tries = S.shape(n)
        assert n / 2**k <= S.CROWD and tries > S.shape(2)[1] and S.recall(k, tries) >= S.RECALL > S.recall(k, tries - 1)


@pytest.mark.parametrize("n, m", [(1, 0), (200, 150), (300, 600)])
def test_components(spark, n, m):
    rng = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b] + ([(i, i + 1) for i in range(1000, 1200)] if m else [])
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in _common.components(_common.Workspace(spark, "test"), df).collect()}
    assert got == want


def at_threshold(n, m, count, seed):
    """Pairs of texts of n and m shingles that are 0.8 alike (or next above)."""
    rng, pairs = random.Random(seed), []
    while len(pairs) < count:
        both = next(c for c in range(1, n + 1) if c >= 0.8 * (n + m - c))
        base = [f"w{rng.randrange(10**9)}" for _ in range(both + 4)]
        more = lambda x: [f"v{rng.randrange(10**9)}" for _ in range(x)]
        pairs.append((" ".join(base + more(n - both)), " ".join(more(m - both) + base)))
    return pairs


@pytest.mark.parametrize("n, m", [(500, 500), (200, 230), (45, 45), (36, 45)])
def test_recall_at_the_threshold(n, m):
    """Of pairs at 0.8, RECALL share a prefix of the depth and are within far(), but for the spread of a sample."""
    k, tries = S.shape(10**6)
    order = np.array([np.random.default_rng(t).permutation(S.BITS)[:k] for t in range(tries)])
    met = []
    for a, b in at_threshold(n, m, 1500, n + m):
        x = S.simhash(S.shingles(a)) != S.simhash(S.shingles(b))
        met.append(not x[order].any(1).all() and x.sum() <= S.far(low=S.SHORT + 1))
    assert np.mean(met) >= S.RECALL - 3 * (0.02 * 0.98 / len(met)) ** 0.5


def test_short_texts_are_found(spark):
    pairs = [p for n, m in ((4, 5), (12, 15), (24, 24), (26, 32)) for p in at_threshold(n, m, 150, n)]
    assert all(jaccard(a, b) >= 0.8 for a, b in pairs)
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [i for i in got if got[i] != i - i % 2]
    assert len(lost) <= 3  # more than far() bits: 0.2 % of such pairs


def test_negative_ids(spark):
    rows = [(i - 40, t) for i, t in corpus(2, 4, 4)]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got.values()) < 0 and got == brute(rows) and len(set(got.values())) < len(rows)


def test_words_alone_count(spark):
    rows = [(1, "One, two; three!"), (2, "one two\nTHREE"), (3, "one-two (three)"), (4, "!!! ???"), (5, "!!!  ???"), (6, "???"), (7, None), (8, ""), (9, "ÉTÉ 12"), (10, "été: 12.")]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9}


def test_long_texts_and_ties(spark):
    """Texts of 300,000 words, and a group whose members all differ from one another in as many bits."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    base = [f"v{i}" for i in range(100)]
    rows = [(0, " ".join(long)), (1, " ".join(["x", *long])), (2, " ".join(reversed(long)))]
    rows += [(10 + i, " ".join([*base[:i], "same", *base[i + 1 :]])) for i in range(0, 60, 2)]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2} | {10 + i: 10 for i in range(0, 60, 2)}


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "k") for i, t in [(None, "a b"), (3, "A, b"), (2, "a b")]], "doc_id long, text string, key string").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op10_simhash_near_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, None, False), (3, 2, False), (2, 2, True)], key=str)


def test_what_simhash_misses_is_found(spark):
    """Pairs at the threshold that share no prefix in any of the forest's tries, or differ in more bits than far()."""
    k, tries = S.shape(10**6)
    order = np.array([np.random.default_rng(t).permutation(S.BITS)[:k] for t in range(tries)])
    missed = []
    for n, m in ((45, 45), (36, 45), (200, 230)):
        for a, b in at_threshold(n, m, 1200, n * m):
            x = S.simhash(S.shingles(a)) != S.simhash(S.shingles(b))
            if x[order].any(1).all() or x.sum() > S.far(low=S.SHORT + 1):
                missed.append((a, b))
    assert len(missed) > 20
    rows = [(2 * i + j, t) for i, p in enumerate(missed) for j, t in enumerate(p)]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == len(rows)


@pytest.mark.parametrize("threshold", [0.8, 0.6, 1.0])
def test_sets_at_the_threshold_share_a_token(threshold):
    rng, found = np.random.default_rng(8), []
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 33, 80, 300] * 30:
        m = int(n * rng.uniform(threshold, 1 / threshold)) or 1
        both = next((c for c in range(1, min(n, m) + 1) if c >= threshold * (n + m - c) - 1e-9), 0)
        base, more = rng.integers(1, 2**63, both).astype(np.uint64), lambda x: rng.integers(1, 2**63, x).astype(np.uint64) * np.uint64(2)
        if both:
            found += [np.unique(np.r_[base, more(x - both)]) for x in (n, m)]
    by = {}
    for i, code in zip(*S.tokens(found, threshold)):
        by.setdefault(int(i), set()).add(int(code))
    assert len(found) > 100 and all(by[i] & by[i + 1] for i in range(0, len(found), 2))


def test_sketches_leave_out_no_pair():
    """Folded sketches differ in no more bits than the sets in shingles, and in many where these do."""
    rng = np.random.default_rng(5)
    for n, m, both in ((4, 5, 4), (30, 37, 30), (60, 70, 58), (500, 620, 500), (500, 500, 300)):
        x, y, z = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (both, n - both, m - both))
        x, y = np.unique(np.r_[x, y]), np.unique(np.r_[x, z])
        rows = {"a": [1], "b": [2], "n_a": [len(x)], "n_b": [len(y)], "odd_a": [S.sketch(x)], "odd_b": [S.sketch(y)]}
        (out,) = S._near(0.8)(iter([S.pa.RecordBatch.from_pydict(rows)]))
        assert out.num_rows == (both >= 0.8 * (n + m - both))


def test_unlike_documents_never_become_pairs():
    """Of a bucket whose documents are unlike none is proposed, however wide; those that may be alike all are."""
    import numpy as np
    import pyarrow as pa

    from cinderfind.llm import simhash as S

    rng = np.random.default_rng(1)
    for size in (6, 60):  # a small bucket and a larger one
        base = [np.unique(rng.integers(0, 2**64, 300, np.uint64)) for _ in range(size)]
        near = np.unique(np.r_[base[0][:-10], rng.integers(0, 2**64, 10, np.uint64)])  # at 290 / 310
        sets = [*base, near, base[1][:150]]
        nodes = pa.record_batch([pa.array(range(len(sets))), pa.array([len(x) for x in sets], pa.int32()), pa.array([S.sketch(x) for x in sets]), pa.array([1] * (len(sets) - 1) + [2])], names=["node", "n", "odd", "texts"])
        rows = next(iter(S._folded([nodes])))
        ids = rows.column("node")
        batch = pa.record_batch([pa.array([7] * len(sets)), pa.array([0] * len(sets)), ids, ids, rows.column("n"), rows.column("fold")], names=["bucket", "side", "node", "label", "n", "fold"])
        out = [r for b in S._propose(1000, 0.8)([batch]) for r in b.to_pylist()]
        many = len(sets) - 1  # a node of several texts may be like any
        assert {(r["a"], r["b"]) for r in out} == {(0, size)} | {(i, many) for i in range(many)}
