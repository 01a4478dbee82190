import json

import pytest
from pyspark.sql import functions as F

from cinderfind.operators import chunking
from cinderfind.operators.ingest import chunks_of
from cinderfind.operators.lexical import websearch_units
from cinderfind.plans.observe import OTelObserver
from cinderfind.sources.adapters import RECORD
from cinderfind.sources.tables import last_wins, staged


def test_last_to_arrive_wins(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int").coalesce(1)
    assert sorted(tuple(r) for r in last_wins(rows, ["k"], None).collect()) == [(0, 27), (1, 28), (2, 29)]


def test_staged_rows_are_made_once(spark, tmp_path):
    made = staged(spark, str(tmp_path), spark.range(5).withColumn("u", F.expr("uuid()")))
    assert made.collect() == made.collect() and made.count() == 5


def test_chunkers_of_records(spark):
    body = "# Guide\nlead words\n## Setup\none two three\n## Use\nfour five"
    rows = spark.createDataFrame([("a", [("Title", "Guide"), ("Body", body)], json.dumps({"title": "Guide"}), "a.md"), ("b", [("Note", "only this")], "{}", "b")], RECORD)
    whole = {r.doc_id: r for r in chunks_of(rows).collect()}
    assert len(whole) == 2 and whole["a"].chunk_id == "a::chunk-0000" and whole["a"].text.startswith("Title: Guide\nBody: # Guide") and whole["b"].text == "Note: only this"
    cut = chunks_of(rows, lambda r: chunking.markdown(r, 30, 5)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section_path) for r in cut] == [("a::chunk-0000", "Guide"), ("a::chunk-0001", "Guide > Setup"), ("a::chunk-0002", "Guide > Use"), ("b::chunk-0000", "b")]
    assert cut[1].text == "Title: Guide\nSection: Setup\nContent: ## Setup\none two three"


@pytest.mark.parametrize("text, units", [
    ("a or -b \"c d\" OR e", [(0, False, ["a"]), (1, True, ["b"]), (1, False, ["c", "d"]), (2, False, ["e"])]), ("-\"x y\" z-1", [(0, True, ["x", "y"]), (0, False, ["z", "1"])]), ("-- !", []), ("", []),
])
def test_websearch(spark, text, units):
    got = websearch_units(spark.createDataFrame([(0, text)], "query_id int, text string")).orderBy("unit").collect()
    assert [(r.alt, r.negative, r.tokens) for r in got] == units


class Span:
    def __init__(self, tracer, name, attributes, start_time):
        self.name, self.attributes, self.start, self.events, self.end_time = name, attributes, start_time, [], None
        tracer.spans.append(self)

    def add_event(self, name, attributes):
        self.events.append((name, attributes))

    def end(self, end_time):
        self.end_time = end_time

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class Tracer:
    def __init__(self):
        self.spans = []

    def start_span(self, name, attributes, start_time):
        return Span(self, name, attributes, start_time)

    def start_as_current_span(self, name, attributes, start_time, end_on_exit):
        return Span(self, name, attributes, start_time)


def test_spans(spark, tmp_path):
    from cinderfind.operators.embed import HashProvider
    from cinderfind.operators.ingest import Pipeline
    from cinderfind.operators.retriever import Retriever
    from cinderfind.plans.policy import Router
    from cinderfind.sources.catalog import Catalog
    from cinderfind.sources.stores import VectorStore

    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.create_schema()
    first, second = HashProvider(16), HashProvider(8, model="small")
    stores = {p.space.space_id: VectorStore(spark, str(tmp_path / p.space.space_id), p.space.space_id, p.space.dimension) for p in (first, second)}
    Pipeline(catalog, stores, first, second).ingest(spark.createDataFrame([("a", [("Body", "rotate the keys")], "{}", "a")], RECORD))
    tracer = Tracer()
    Retriever(catalog, stores, Router(first, second, daily_usd="0", usd_per_million="1"), OTelObserver(tracer, {"service": "x"}, now=lambda: 10**15)).retrieve("rotate")
    root = tracer.spans[0]
    assert [s.name for s in tracer.spans] == ["retrieve", "embeddings small", "dense.search table", "lexical.search bm25", "fuse rrf"]
    assert [e[0] for e in root.events] == ["retrieval.fallback", "budget.threshold_crossed"] and root.events[0][1]["retrieval.provider.reason"] == "budget_daily_exceeded"
    assert root.attributes["service"] == "x" and root.attributes["retrieval.fallback"] and not any("rotate" in str(v) for v in root.attributes.values())
    assert root.end_time == 10**15 and all(root.start <= s.start <= s.end_time <= root.end_time for s in tracer.spans[1:])
    assert tracer.spans[2].attributes["retrieval.result.count"] == 1
