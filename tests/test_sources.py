import json

import pytest

from cinderfind.model import SourceError, Space
from cinderfind.sources import adapters as A
from cinderfind.sources.stores import VectorStore, create_store, register_store
from cinderfind.sources.tables import Table


def records(df):
    return [(r.id, {f.label: f.value for f in r.semantic}, json.loads(r.structured), r.source) for r in df.orderBy("id").collect()]


def test_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("---\ndoc_id: KB-1\nstatus: 'OPEN'\nseverity: 3\nratio: 1.5\ntags:\n  - a\n  - b\nmap:\n  x: 1\n---\n# Head line #\n\nBody text\n## More\n")
    (tmp_path / "sub" / "a.md").write_text("no front\n")
    (tmp_path / "c.txt").write_text("not read")
    got = records(A.read(spark, str(tmp_path), "markdown"))
    assert got[0] == ("KB-1", {"Title": "Head line", "Body": "Body text\n## More"}, {"status": "OPEN", "severity": 3, "ratio": 1.5, "doc_id": "KB-1", "title": "Head line"}, "b.md")
    assert got[1][0] == "a" and got[1][3] == "sub/a.md"


@pytest.mark.parametrize(
    "text, meta, body",
    [
        ("plain\n---\nx", {}, "plain\n---\nx"), ("---\na: 1\nno end", {}, "---\na: 1\nno end"), ("---\na: ~\nb: true # no\nc: 'x'\nd: -4\n---\n\nbody\n", {"a": None, "b": "true # no", "c": "x", "d": -4}, "body"),
        ("---\nm:\n  n:\n    k: v\n  l:\n    - 1\n    - 2.5\nz: .5\n---\n", {"m": {"n": {"k": "v"}, "l": [1, 2.5]}, "z": 0.5}, ""),
    ],
)
def test_frontmatter(text, meta, body):
    assert A.frontmatter(text) == (meta, body)


@pytest.mark.parametrize("block", ["a:\n\tb: 1", "- x", "just words", ": v"])
def test_frontmatter_refuses(block):
    with pytest.raises(SourceError):
        A.frontmatter(f"---\n{block}\n---\n")


def test_blank_title_is_an_error():
    with pytest.raises(SourceError):
        A.markdown_record("---\ntitle: ''\n---\n# T\nx", "s", "stem")


def test_csv(spark, tmp_path):
    p = tmp_path / "faq.csv"
    p.write_text('﻿Term ID,Detail Text,Variable Rate,Fee Amount,Code\n7,"a, b",TRUE,12,007\n8,"two\nlines",false,1.50,\n', encoding="utf-8")
    got = records(A.read(spark, str(p), "csv", semantic=["detail text"]))
    assert got[0] == ("7", {"Detail Text": "a, b"}, {"Variable Rate": True, "Fee Amount": 12, "Code": "007"}, str(p))
    assert got[1][1] == {"Detail Text": "two\nlines"} and got[1][2] == {"Variable Rate": False, "Fee Amount": 1.5}
    for text in ("a,a\n1,2\n", "id,text\n1,2,3\n", "", "id,text\n ,x\n", "x,y\n1,2\n"):
        with pytest.raises(SourceError):
            A.csv_records(text, "s")
    assert A.csv_records("key;copy;state\nk;c;open\n", "s", ";", id_name="key", semantic={"Copy": "copy"}, structured=["state"])[0]["structured"] == '{"state": "open"}'


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"doc_id": "1", "title": "T", "n": [1]}, {"doc_id": "2", "title": "U", "rank": 2}]}))
    (tmp_path / "b.jsonl").write_text('{"doc_id": "3", "text": "x", "rank": "2"}\n\n{"doc_id": 4, "text": "y"}\n')
    got = records(A.read(spark, str(tmp_path), "json"))
    assert [g[0] for g in got] == ["1", "2", "3", "4"]
    assert got[0][2] == {} and got[1][2] == {"rank": 2} and got[2][2] == {"rank": "2"}
    for text, by_line in (("[1]", False), ("{", False), ('{"doc_id": "1", "title": {"a": 1}}', False), ('"x"\n', True)):
        with pytest.raises(SourceError):
            A.json_records(text, "s", by_line)


def test_nothing_to_read(spark, tmp_path):
    for path, kind in ((tmp_path, "csv"), (tmp_path / "none.csv", "csv"), (tmp_path, "markdown")):
        with pytest.raises(SourceError):
            A.read(spark, str(path), kind)


def test_id_inference():
    assert A.id_field(["Name", "Document ID", "x_id"]) == "Document ID"
    assert A.id_field(["Name", "case_id"]) == "case_id"
    with pytest.raises(SourceError):
        A.id_field(["Name"])
    with pytest.raises(SourceError):
        A.id_field(["a b", "a-b"], "A_B")


def test_table(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    t = Table(spark, str(tmp_path / "t"), schema, ["k"])
    assert t.read().count() == 0 and t.version() is None
    t.upsert(spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, o int"), "o")
    first = t.version()
    t.upsert(spark.createDataFrame([("b", 4)], "k string, v int"))
    assert sorted(t.read().collect()) == [("a", 2), ("b", 4)] and t.version() != first
    t.delete(spark.createDataFrame([("a",), ("zz",)], "k string"))
    t.vacuum()
    assert t.read().collect() == [("b", 4)]


META = lambda **kw: json.dumps(kw)


def store(spark, path):
    s = create_store("table", spark=spark, path=str(path), space_id=Space("p", "m", 3).space_id, dimension=3)
    rows = [("alpha", "A", META(doc_type="runbook", priority=3, active=True), [2.0, 0.0, 0.0]), ("beta", "B", META(doc_type="known_issue", priority=2, active=True), [0.8, 0.6, 0.0]), ("gamma", "C", META(doc_type="policy", priority=1, active=False), [0.0, 1.0, 0.0])]
    s.upsert(spark.createDataFrame(rows, "id string, text string, metadata string, vector array<float>"))
    return s


def test_store(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    assert [(r.id, round(r.score, 6)) for r in s.search([1, 0, 0], 2).collect()] == [("alpha", 1.0), ("beta", 0.8)]
    assert [r.id for r in s.search([1, 0, 0], 5, {"priority": {"$lte": 2}}).collect()] == ["beta", "gamma"]
    assert s.search([1, 0, 0], 0).count() == 0
    s.upsert(spark.createDataFrame([("alpha", "A2", META(x=1), [0.0, 0.0, 0.0])], "id string, text string, metadata string, vector array<float>"))
    assert [r.text for r in s.get(["beta", "nope", "alpha", "beta"]).collect()] == ["B", "A2", "B"]
    assert s.search([1, 0, 0], 5, {"doc_type": "runbook"}).count() == 0
    assert {r.id: r.score for r in s.search([1, 0, 0], 5).collect()}["alpha"] == 0.0
    s.delete(spark.createDataFrame([("beta",), ("nope",)], "id string"))
    assert s.count() == 2
    s.save(str(tmp_path / "saved"))
    again = VectorStore.load(spark, str(tmp_path / "saved"), str(tmp_path / "again"))
    assert again.count() == 2 and again.dimension == 3
    for bad in ([1.0], [1.0, float("nan"), 0.0]):
        with pytest.raises(Exception, match="finite"):
            s.upsert(spark.createDataFrame([("x", "t", "{}", bad)], "id string, text string, metadata string, vector array<float>"))
    with pytest.raises(ValueError):
        s.search([1.0], 1)
    with pytest.raises(ValueError):
        create_store("nope")
    with pytest.raises(ValueError):
        register_store("", VectorStore)


def test_csv_is_a_stream_of_long_rows(spark, tmp_path):
    """A field of any length, and no more lines are taken than records ask for."""
    (tmp_path / "a.csv").write_text('id,text\n1,"' + 'long "" text\n' * 30_000 + '"\n2,b\n')
    got = records(A.read(spark, str(tmp_path), "csv"))
    assert [(g[0], len(g[1]["text"])) for g in got] == [("1", 12 * 30_000), ("2", 1)]
    taken = []
    rows = A.csv_rows((taken.append(i) or f"{i},x\n" if i else "id,text\n" for i in range(100)), "s")
    assert next(rows)["id"] == "1" and len(taken) < 3


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_json_is_a_stream(spark, tmp_path, block):
    import io

    text = {"id": "1", "text": 'a "q" \\   é {[,]}', "n": -12.5e3, "deep": [{"x": [1, None, True]}]}
    for whole, want in (([text, text], 2), ({"before": [1, {}], "records": [text] * 3, "after": "x"}, 3), (text, 1), ({"records": [], "a": 1}, 0), ([], 0)):
        for indent in (None, 2):
            got = list(A.json_rows(io.StringIO(json.dumps(whole, indent=indent)), "s", False, block=block))
            assert got == [A.mapped(text, "s")] * want
    for bad in ('[{"id": "1", "text": "a"}', '[{"id": "1", "text": "a"}] x', '{"records": [],}', '{"records": [] "a": 1}', '{"id": 1', "", '[{"id": "1", "text": "a"},]', "{,}"):
        with pytest.raises(SourceError):
            list(A.json_rows(io.StringIO(bad), "s", False, block=block))
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "a b\x85c"}\r\n{"id": "2", "text": "d"}', newline="")
    assert [g[1]["text"] for g in records(A.read(spark, str(tmp_path), "json"))] == ["a b\x85c", "d"]


def test_many_files_are_few_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"d{i % 3} x").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3} x" / f"{i}.md").write_text("text")
    for hidden in ("_no", ".no", "d0 x/_no"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "none.md").write_text("text")
    got = A.read(spark, str(tmp_path), "markdown")
    assert got.rdd.getNumPartitions() <= 16
    assert sorted((r.id, r.source) for r in got.collect()) == sorted((str(i), f"d{i % 3} x/{i}.md") for i in range(600))


def test_lines_become_files_in_pieces(spark, tmp_path):
    from cinderfind.table_queries import _write_lines

    rows = spark.range(1000).repartition(7).selectExpr("concat(id % 3, '.csv') as name", "cast(id as string) as line")
    _write_lines(rows, f"file://{tmp_path}/at", {"csv": ("head\n", "\n", "\nend")})
    assert sorted(p.name for p in (tmp_path / "at").iterdir()) == ["0.csv", "1.csv", "2.csv"]
    for k in range(3):
        lines = (tmp_path / "at" / f"{k}.csv").read_text().split("\n")
        assert lines[0] == "head" and lines[-1] == "end" and sorted(map(int, lines[1:-1])) == list(range(k, 1000, 3))
