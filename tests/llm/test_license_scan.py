import random

from cinderfind.llm import license_scan as L


def brute(rows, templates):
    out = set()
    for name, t in ((k, t) for k, v in templates.items() for t in ([v] if isinstance(v, str) else v)):
        w = L._words(t)
        if not w:
            continue
        k = min(5, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, text in rows:
            x = L._words(text or "")
            places = [a for a in range(len(x)) if tuple(x[a : a + k]) in want]
            for a in places:
                inside = {tuple(x[b : b + k]) for b in places if a <= b <= a + len(w) - k}
                if len(inside) / len(want) >= 0.8:
                    out.add((i, name))
                    break
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["license", "the", "of", "this", "work", "is", "under", "lorem", "ipsum", "dolor"]) for _ in range(n))
    long = " ".join(f"word{i}" for i in range(60))
    templates = L.LICENSES | {"long": long, "tiny": "Public domain", "none": " -- "}
    rows = []
    for i in range(80):
        parts = [filler(rng.randrange(60))]
        for name in rng.sample(sorted(templates), rng.randrange(3)):
            w = templates[name] if isinstance(templates[name], str) else rng.choice(templates[name])
            w = w.split()
            if len(w) > 12 and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper() if i % 4 == 0 else " ".join(w), filler(rng.randrange(30))]
        rows.append((i, "\n".join(parts)))
    rows += [(900, None), (901, ""), (902, "License " * 5000), (None, L.LICENSES["MIT"][1]), (1, L.LICENSES["MIT"][0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = L.scan(df, templates).collect()
    assert {(r.doc_id, r.license) for r in got} == brute(rows, templates) and len({(r.doc_id, r.license) for r in got}) == len(got)
    assert all(r.containment >= 0.8 for r in got)
    monkeypatch.setattr(L, "SEGMENT", 40)  # occurrences that segments part
    assert {(r.doc_id, r.license) for r in L.scan(df, templates).collect()} == brute(rows, templates)
    assert "Python" not in L.scan(df, templates)._jdf.queryExecution().toString()


def test_none(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r.license, r.containment, r.word_start) for r in L.scan(df).collect()] == [("MIT", 1.0, 0)]
    assert L.scan(df, {}).count() == 0 and L.scan(df.limit(0)).count() == 0


def test_long_texts(spark):
    body = L.LICENSES["MIT"][0]
    plain = ("lorem ipsum dolor sit amet " * 20 + "license ") * 9_900 + body  # a million words
    dense = "license software copyright " * 5_000 + body
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(1, plain), (2, dense)], "doc_id long, text string")).collect()}
    assert {i: (r.license, r.containment) for i, r in got.items()} == {1: ("MIT", 1.0), 2: ("MIT", 1.0)}
    assert 999_800 < got[1].word_start <= 999_900 and 14_900 < got[2].word_start <= 15_000


def test_bodies(spark):
    names = ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "ISC", "Zlib"]
    df = spark.createDataFrame([(i, "Copyright (c) 2020 Someone\n\n" + L.LICENSES[n][0].replace(". ", ".\n * ")) for i, n in enumerate(names)], "doc_id long, text string")
    got = {(r.doc_id, r.license): r.containment for r in L.scan(df).collect()}
    assert all(got[i, n] == 1.0 for i, n in enumerate(names)) and all(v < 1.0 for (i, n), v in got.items() if n in names and names.index(n) != i)


def test_anchors_hit_what_a_match_cannot_miss():
    for t, hit in L.anchors([" ".join(L._words(t)) for v in L.LICENSES.values() for t in v]).items():
        w = t.split()
        shingles = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        assert sum(bool(hit & set(s)) for s in shingles) > 0.2 * len(shingles) - 1e-9


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "SPDX-License-Identifier: MIT", "en"), (2, None, "en")], "doc_id long, text string, license string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in L.op9_license_scan(spark, str(tmp_path)).collect()] == [(1, "MIT", 1.0, 0)]
