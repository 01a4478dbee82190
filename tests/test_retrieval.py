import json

import pytest

from cinderfind.model import Scope
from cinderfind.operators.embed import HashProvider, Provider
from cinderfind.operators.ingest import Pipeline
from cinderfind.operators.retriever import Config, Retriever, build
from cinderfind.plans.observe import LogObserver
from cinderfind.plans.policy import Router
from cinderfind.sources.adapters import RECORD
from cinderfind.sources.catalog import Catalog
from cinderfind.sources.stores import VectorStore
from cinderfind.streaming.ingest import start


def record(id_, title, body, **structured):
    return (id_, [("Title", title), ("Body", body)], json.dumps(structured), f"{id_}.md")


ROWS = [
    record("INC-1104", "Payments report fails", "SQLSTATE 23505 raised by payments reporting", severity=3, tenant_id="acme", visibility="internal", doc_type="incident"),
    record("KB-77", "Shared network notes", "network routing and certificate rotation", doc_type="kb"),
    record("SEC-1", "Secret network rotation", "certificate rotation of the secret network", severity=1, tenant_id="globex", visibility="restricted", doc_type="incident"),
]


class Broken(Provider):
    def __init__(self):
        self.space = HashProvider(64).space

    def embed_texts(self, texts):
        raise RuntimeError("down")


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    catalog = Catalog(spark, str(root / "catalog"))
    catalog.create_schema()
    catalog.validate_schema()
    first, second = HashProvider(64), HashProvider(32, model="small")
    stores = {p.space.space_id: VectorStore(spark, str(root / p.space.space_id), p.space.space_id, p.space.dimension) for p in (first, second)}
    pipeline = Pipeline(catalog, stores, first, second, Router(first, second))
    done = pipeline.ingest(frame(spark))
    assert (done.documents, done.chunks, done.removed) == (3, 3, 0) and set(done.embedded.values()) == {3}
    return catalog, stores, pipeline, first, second


def hits(result, query_id="q"):
    return [r.doc_id for r in result.hits.filter(result.hits.query_id == query_id).orderBy("rank").collect()]


def test_documents(engine):
    row = engine[0].find({"severity": 3}).first()
    assert (row.doc_id, row.title, row.tenant_id, json.loads(row.attributes)) == ("INC-1104", "Payments report fails", "acme", {"severity": 3})
    assert [r.doc_id for r in engine[0].find({"doc_type": "incident"}, Scope("acme")).collect()] == ["INC-1104"]
    assert [r.doc_id for r in engine[0].find(None, Scope("acme")).collect()] == ["INC-1104", "KB-77"]
    with pytest.raises(ValueError):
        engine[0].find(limit=0)


def test_hybrid(engine):
    catalog, stores, _, first, second = engine
    log = LogObserver()
    r = Retriever(catalog, stores, Router(first, second), log)
    got = r.retrieve({"q": "certificate rotation", "p": "SQLSTATE 23505"})
    assert set(hits(got)[:2]) == {"KB-77", "SEC-1"} and hits(got, "p")[0] == "INC-1104"
    assert (got.provider_reason, got.fallback_occurred, got.degraded) == ("primary", False, False)
    row = got.hits.filter("query_id = 'p' and rank = 1").first()
    assert row.dense_rank == 1 and row.lexical_rank == 1 and row.score == pytest.approx(1 / 61 + 2 / 61)
    assert len(log.rows) == 1 and "hits" not in log.rows[0]


def test_scope_is_stricter_for_dense(engine):
    catalog, stores, _, first, second = engine
    got = Retriever(catalog, stores, Router(first, second)).retrieve("certificate rotation", scope=Scope("acme"))
    rows = {r.doc_id: r for r in got.hits.collect()}
    assert "SEC-1" not in rows and rows["KB-77"].dense_rank is None and rows["KB-77"].lexical_rank == 1
    assert rows["INC-1104"].lexical_rank is None


def test_degradation(engine, spark, tmp_path):
    catalog, stores, _, first, second = engine
    got = Retriever(catalog, stores, Router(Broken(), second)).retrieve("certificate rotation")
    assert got.fallback_occurred and not got.degraded and got.model == "small" and got.errors
    got = Retriever(catalog, stores, Router(Broken())).retrieve("certificate rotation")
    assert got.degraded and set(hits(got)) == {"KB-77", "SEC-1"}
    got = Retriever(catalog, stores, Router(first, enabled=False)).retrieve("certificate rotation")
    assert got.degraded and got.provider is None
    bare = Catalog(spark, str(tmp_path / "bare"))
    bare.create_schema()
    got = Retriever(bare, stores, Router(first)).retrieve("certificate")
    assert got.degraded and "lexical unavailable" in got.errors[0] and got.hits.count() == 0
    assert hits(build(catalog, stores).retrieve("certificate rotation", k=1)) in (["KB-77"], ["SEC-1"])

    class Bad:
        def on_retrieval(self, result):
            raise RuntimeError

    assert hits(Retriever(catalog, observer=Bad()).retrieve("rotation"))


def test_refusals(engine):
    catalog, stores, _, first, _ = engine
    r = Retriever(catalog, stores, Router(first))
    for args, kw in (((" ",), {}), (("x",), {"k": 0})):
        with pytest.raises(ValueError):
            r.retrieve(*args, **kw)
    with pytest.raises(ValueError):
        Config(dense_k=0)


def test_incremental(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.create_schema()
    p = HashProvider(16)
    store = VectorStore(spark, str(tmp_path / "v"), p.space.space_id, 16)
    pipe = Pipeline(catalog, {p.space.space_id: store}, p)
    sid = p.space.space_id
    assert pipe.ingest(frame(spark)).embedded[sid] == 3
    again = pipe.ingest(frame(spark))
    assert again.embedded[sid] == 0 and again.skipped[sid] == 3
    changed = [record("KB-77", "Shared network notes", "network routing and certificate rotation", doc_type="kb", severity=9)]
    assert pipe.ingest(frame(spark, changed)).embedded[sid] == 1
    assert json.loads(store.get(["KB-77::chunk-0000"]).first().metadata)["severity"] == 9
    with pytest.raises(ValueError):
        pipe.ingest(frame(spark, ROWS + ROWS[:1]))
    removed = catalog.replace_chunks(spark.createDataFrame([("KB-77",)], "doc_id string"), catalog.chunks.read().limit(0))
    assert [r.chunk_id for r in removed.collect()] == ["KB-77::chunk-0000"]
    assert catalog.embedding_state(p.space).count() == 2 and catalog.embedding_state(p.space, []).count() == 0
    catalog.invalidate(spark.createDataFrame([("SEC-1::chunk-0000",)], "chunk_id string"))
    assert [r.chunk_id for r in catalog.stale_chunk_ids(p.space).collect()] == ["SEC-1::chunk-0000"]
    assert pipe.reembed_stale(p).embedded[sid] == 1
    catalog.delete_documents(spark.createDataFrame([("INC-1104",)], "doc_id string"))
    assert catalog.chunks.read().count() == 1 and catalog.embedding_state(p.space).count() == 1
    with pytest.raises(ValueError):
        catalog.upsert_chunks(spark.createDataFrame([("x", "nobody", "t", 0)], "chunk_id string, doc_id string, text string, chunk_index int"))


def test_streaming(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.create_schema()
    p = HashProvider(8)
    pipe = Pipeline(catalog, {p.space.space_id: VectorStore(spark, str(tmp_path / "v"), p.space.space_id, 8)}, p)
    frame(spark).write.parquet(str(tmp_path / "in"))
    query = start(spark.readStream.schema(frame(spark).schema).parquet(str(tmp_path / "in")), pipe, str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    assert catalog.documents.read().count() == 3


def test_what_is_unchanged_is_not_written_again(spark, tmp_path):
    """A second ingest of the same records leaves the tables' versions and the index; changed ones replace theirs alone."""
    from pyspark.sql import functions as F

    from cinderfind.operators.embed import HashProvider
    from cinderfind.operators.ingest import Pipeline
    from cinderfind.sources.adapters import RECORD
    from cinderfind.sources.catalog import Catalog
    from cinderfind.sources.stores import VectorStore

    catalog, provider = Catalog(spark, str(tmp_path / "c")), HashProvider(8)
    catalog.create_schema()
    store = VectorStore(spark, str(tmp_path / "v"), provider.space.space_id, 8)
    pipe = Pipeline(catalog, {provider.space.space_id: store}, provider)
    rows = lambda text, size: spark.createDataFrame([(i, [("Body", text if i == "a" else f"word {i}")], f'{{"size": {size if i == "b" else 1}}}', "s") for i in "abc"], RECORD)
    versions = lambda: (catalog.documents.version(), catalog.chunks.version(), catalog.embedded.version(), store.table.version(), catalog._indexed())
    found = lambda word: {r.chunk_id[0] for r in catalog.search_lexical(spark.createDataFrame([("q", word)], "query_id string, text string")).collect()}
    assert pipe.ingest(rows("old", 1)).chunks == 3
    first = versions()
    again = pipe.ingest(rows("old", 1))
    assert versions() == first and again.chunks == 3 and again.skipped == {provider.space.space_id: 3}
    pipe.ingest(rows("old", 2))  # metadata alone: the chunks and their index stay
    assert versions()[1] == first[1] == versions()[4] and versions()[0] != first[0]
    assert sorted(r.metadata for r in store.rows().filter(F.col("id").startswith("b")).collect())[0].find('"size":2') > 0
    last = pipe.ingest(rows("new text", 2))
    assert list(last.embedded.values()) == [1] and catalog.chunks.version() == catalog._indexed() != first[1]
    assert catalog.chunks.read().count() == store.count() == catalog.embedded.read().count() == 3
    assert found("old") == set() and found("new") == {"a"} and found("word") == {"b", "c"}


def test_the_index_is_written_without_a_shuffle(spark, tmp_path):
    from cinderfind.operators import lexical

    texts = {"a": "b c b", "d": "", "e": "c c é", "f": "x"}
    index = lexical.build(spark.createDataFrame(list(texts.items()), "chunk_id string, text string"))
    lexical.write(index, str(tmp_path / "i"))
    got = lexical.read(spark, str(tmp_path / "i"))
    for a, b in ((got.postings.select("chunk_id", "pos", "term"), index.postings.select("chunk_id", "pos", "term")), (got.lengths, index.lengths)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    import pyarrow as pa

    held, lexical.RUN = lexical.RUN, 2
    try:
        out = list(lexical._runs([pa.record_batch([pa.array(list("abcd")), pa.array([["z", "a", "z"], [], ["b"], ["y", "b"]])], names=["chunk_id", "terms"])]))
    finally:
        lexical.RUN = held
    rows = [[tuple(r.values()) for r in b.to_pylist()] for b in out]
    assert all([r[2] for r in run] == sorted(r[2] for r in run) for run in rows) and len(rows) > 1
    assert sorted(sum(rows, [])) == [("a", 0, "z"), ("a", 1, "a"), ("a", 2, "z"), ("c", 0, "b"), ("d", 0, "y"), ("d", 1, "b")]


def test_last_to_arrive_wins_without_one_task(spark, tmp_path):
    """catalog_chunks has no step whose single task reads all turns."""
    import inspect

    from cinderfind import table_queries

    assert "coalesce(1)" not in inspect.getsource(table_queries.catalog_chunks)
