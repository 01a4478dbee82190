import random

import pytest

from cinderfind.llm import line_dedup


def brute(rows, min_lines=2, min_words=25):
    """Text by row: a line goes if it is in a run of min_lines lines, or a line of min_words words, seen earlier."""
    seen, out = set(), {}
    order = sorted({(i if i is not None else 1 << 63, i, t or "") for i, t in rows}, key=lambda r: r[0])
    for _, i, text in order:
        lines = text.split("\n")
        full = [(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(full)):
            if len(full[a][1].split()) >= min_words:
                key = (full[a][1],)
                gone |= {full[a][0]} if key in seen else set()
                seen.add(key)
            if a + min_lines <= len(full):
                key = ("run", *(x for _, x in full[a : a + min_lines]))
                gone |= set(range(full[a][0], full[a + min_lines - 1][0] + 1)) if key in seen else set()
                seen.add(key)
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("min_lines", [2, 4])
def test_against_brute_force(spark, min_lines):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lines = [rng.choice(["a", "b", "c", "", " d ", "e" * 3, " ".join("w" * 26)]) for _ in range(rng.randrange(0, 14))]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, "q\nr\n" * 40)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=min_lines).collect()
    want = brute(rows, min_lines)
    assert {(r.doc_id, r.text) for r in got} == {(i, want[i, t]) for i, t in rows}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a\nb\nc", "x", 7), (1, "a\nb\nc", "x", 7), (2, None, "y", 8), (3, "", "z", 9), (None, "a\nb\nnew", "n", 1), (4, "z\na\nb", "m", 2), (5, "a", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, rank int")
    got = sorted(((r.doc_id, r.text, r["rank"], [tuple(s) for s in r.removed]) for r in line_dedup.dedup(df).collect()), key=str)
    want = [(1, "a\nb\nc", 7, []), (1, "a\nb\nc", 7, []), (2, None, 8, []), (3, "", 9, []), (None, "new", 1, [(0, 2)]), (4, "z", 2, [(1, 3)]), (5, "a", 3, [])]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_long_run_in_one_document(spark):
    got = line_dedup.dedup(spark.createDataFrame([(1, "\n".join(["same"] * 500))], "doc_id long, text string")).first()
    assert got.text == "same" and [tuple(s) for s in got.removed] == [(1, 500)]


def test_short_single_lines(spark):
    rows = [(i, f"own {i} a\nfoot of every page\nown {i} b\nby hand\nown {i} c\nword") for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 else f"own {i} a\nown {i} b\nown {i} c\nword" for i, t in rows}


def test_rows_without_ids_and_long_texts(spark, tmp_path):
    """Rows without an id come last, each a document of its own; a text of 3,000 lines loses what an earlier one has."""
    run = "\n".join(f"a shared line number {i}" for i in range(1500))
    rows = [(1, run), (2, "\n".join(f"own line {i} of two" for i in range(1500)) + "\n" + run)]
    rows += [(None, f"own first line {i}\nthis line is in all\nand so is this") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == 32
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].removed_lines == 0 and by[2].removed_lines == 1500 and "shared" not in by[2].text
    assert sorted(r.removed_lines for r in got if r.doc_id is None) == [0] + [2] * 29
