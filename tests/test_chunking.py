import pytest

from cinderfind.operators import chunking as K


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_windows(spark):
    df = spark.createDataFrame([("d", " ".join("abcdefghijkl")), ("e", "  "), ("f", "one")], "doc_id string, text string")
    got = K.windows(df, 5, 2).orderBy("chunk_id").collect()
    assert [r.text for r in got] == ["a b c d e", "d e f g h", "g h i j k", "j k l", "one"]
    assert got[3].chunk_id == "d::chunk-0003"


@pytest.mark.parametrize("args", [(0, 0), (5, 5), (5, -1), (True, 0), (5, True), (5.0, 1)])
def test_window_checks(args):
    with pytest.raises(ValueError):
        K.check_window(*args)


def test_packing():
    assert K.pack_paragraphs(" a b ", 5, 1) == ["a b"]
    assert K.pack_paragraphs("", 5, 1) == []
    text = "a b c\n\nd e\n\nf g h i\n\n" + " ".join("jklmnopq") + "\n\nz"
    assert K.pack_paragraphs(text, 5, 1) == ["a b c\n\nd e", "e\n\nf g h i", "j k l m n", "n o p q", "z"]
    assert K.pack_paragraphs("a b c\n\nd e f g h", 5, 2) == ["a b c", "d e f g h"]
    assert K.pack_paragraphs("a b c\n\nd e f", 3, 0) == ["a b c", "d e f"]


def test_packed_frame(spark):
    df = spark.createDataFrame([(1, "a b c\n\nd e\n\nf"), (2, None)], "doc_id long, text string")
    assert texts(K.packed(df, 3, 0)) == ["a b c", "d e\n\nf"]


MD = "intro\n# Title #\nlead\n\n## One\nx\n### Deep\ny\n# Again\nz\n## Empty\n"


def test_sections(spark):
    df = spark.createDataFrame([("d", MD, "fallback")], "doc_id string, body string, title string")
    got = [(r.title, r.section_path, r.content) for r in K.sections(df).orderBy("section").collect()]
    assert got == [("fallback", "fallback", "intro"), ("Title", "Title", "lead"), ("One", "Title > One", "## One\nx\n### Deep\ny"), ("Again", "Title > Again", "# Again\nz"), ("Empty", "Title > Empty", "## Empty")]


def test_markdown(spark):
    df = spark.createDataFrame([("d", "# T\nlead\n## S\n" + " ".join("abcdefghij"), "f")], "doc_id string, body string, title string")
    got = texts(K.markdown(df, 10, 1))
    assert got[0] == "Title: T\nContent: lead"
    assert got[1] == "Title: T\nSection: S\nContent: ## S a b c" and all(len(t.split()) <= 10 for t in got)
    assert len(K.whole(df, "body").collect()) == 1
