import re
from pathlib import Path

import pytest

import corpus_pipeline as C


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    line = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows, labels = [], []
    for i in range(120):
        text = "\n".join(line() for _ in range(4))
        good = i % 6 != 0
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en", f"s{i % 3}", 0))
        labels.append((i, int(good)))
    shared = line() + "\n" + line()
    rows += [(200, line() + "\n" + shared, "en", "s1", 0), (201, shared + "\n" + line(), "en", "s1", 0), (300, rows[1][1], "en", "s2", 0)]
    near = rows[2][1].split(" ")
    near[0] = "changed"
    rows.append((301, " ".join(near).replace("\n", " "), "en", "s2", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, seen = docs, {}
    for name, stage in C.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert kept.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    junk = {i for i in range(0, 120, 6)}
    assert not ids["quality"] & junk and len(ids["quality"]) >= 100
    text = {r.doc_id: r.text for r in seen["lines"].collect()}
    assert 300 not in text and shared in text[200] and shared not in text[201]
    assert 2 in ids["near_dups"] and 301 not in ids["near_dups"]
    assert ids["mix"] <= ids["near_dups"] and ids["pack"] == ids["mix"]
    again = C.run(spark, str(tmp_path))
    assert sorted(map(str, again.drop("sequence_id", "offset").collect())) == sorted(map(str, seen["pack"].drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "one text", "en", None, 8)]])
def test_few_rows(spark, tmp_path, rows):
    """Empty tables, null ids and sources, empty texts, and columns that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "x", 1.5, "y") for r in rows], schema + ", removed string, score double, class_id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows if (r[1] or "").strip())


def test_tables_go(spark, tmp_path):
    from cinderfind.llm import _common

    docs = spark.createDataFrame([(i, f"text {i} of its own words w{i} v{i}", "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before = len(_common._LIVE)
    out = C.run(spark, str(tmp_path))
    assert len(_common._LIVE) == before + 1 and {p.name for p in Path(_common._LIVE[-1].root.removeprefix("file://")).iterdir()} == {"pack"} and out.count() > 0


def test_entry_registers():
    import __spark_entry__ as entry

    names = [m[1] for n in entry.queries() if (m := re.match(r"(op\d+)_", n))]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
