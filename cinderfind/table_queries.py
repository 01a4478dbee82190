"""Queries that run the engine itself, on tables and files of its own below the cluster's shared folder, and the same
results in SQL. Small state machines (routing, budgets, refusals) are lists of what came of each case."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from cinderfind.functions import text as T
from cinderfind.model import DOCUMENT_COLUMNS, LexicalUnavailable, NoProvider, PricingUnavailable, Scope, SourceError, Space
from cinderfind.operators import chunking, embed, lexical
from cinderfind.operators.ingest import Pipeline
from cinderfind.operators.retriever import Retriever, build
from cinderfind.plans.filters import compile_filter
from cinderfind.plans.observe import LogObserver
from cinderfind.plans.policy import Breaker, Charge, Ledger, Router
from cinderfind.queries import _bm25_sql, _COS, Q1, _sqlv, _t, query
from cinderfind.sources import adapters
from cinderfind.sources.catalog import Catalog
from cinderfind.sources.stores import VectorIndex, VectorStore, create_store

_MADE: list = []


def _folder(spark) -> str:
    """A new folder that all executors see; it goes at the end of the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cinderfind-")
    _MADE.append((spark, at := f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"))
    return at


@atexit.register
def _sweep() -> None:
    for spark, at in _MADE:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


def _values(rows, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'" for v in r) + ")" for r in rows) + f") v({names})"


# vector stores


def _store(spark, d):
    rows = _t(spark, d, "embeddings")
    meta = F.to_json(F.struct("label", F.col("vec_id").alias("n")))
    rows = rows.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("text"), meta.alias("metadata"), F.col("embedding").alias("vector"))
    store = create_store("table", spark=spark, path=_folder(spark), space_id="all", dimension=64)
    store.upsert(rows)
    return store, rows


@query("""SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 4 = 0 THEN '{"changed":true}' ELSE '{"label":' || label || ',"n":' || vec_id || '}' END AS metadata, (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0) AS n
FROM embeddings WHERE vec_id % 5 <> 0""")
def store_upsert_delete(spark, d):
    store, rows = _store(spark, d)
    number = F.col("id").cast("long")
    store.upsert(rows.filter(number % 4 == 0).withColumn("metadata", F.lit('{"changed":true}')))  # replaced, not merged
    store.delete(rows.filter(number % 5 == 0).select("id"))
    return store.rows().select("id", "metadata", F.lit(store.count()).alias("n"))


@query(f"SELECT vec_id::VARCHAR AS id, round({_COS.format(_sqlv(Q1))}, 4) AS score FROM embeddings WHERE label <= 5 ORDER BY {_COS.format(_sqlv(Q1))} DESC, vec_id LIMIT 10")
def store_saved_search(spark, d):
    store, at = _store(spark, d)[0], _folder(spark)
    store.save(f"{at}/saved")
    again = VectorStore.load(spark, f"{at}/saved", f"{at}/loaded")
    return again.search(Q1, 10, {"label": {"$lte": 5}}).select("id", F.round("score", 4).alias("score"))


@query("SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id = 0")
def index_search(spark, d):
    """One row alone holds the words that are asked for."""
    provider = embed.HashProvider(64)
    store = VectorStore(spark, _folder(spark), provider.space.space_id, 64)
    index = VectorIndex(provider, store)
    index.upsert(_t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") == 0, "rare words here").otherwise("other").alias("text"), F.lit("{}").alias("metadata")))
    return index.search("rare words", 1).select("id")


# the catalog, from conversations: one is a document, its turns are chunks


_TURNS = "(SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND trim(text) <> '')"


def _turns(spark, d):
    turns = _t(spark, d, "conversations").filter("text is not null and trim(text) <> ''")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "text", (F.col("turn") % 5 != 4).alias("active"))


def _documents(rows):
    """rows (doc_id, tenant_id, attributes) with the other columns of documents."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*DOCUMENT_COLUMNS, "attributes")])


def _catalog(spark, d):
    catalog = Catalog(spark, _folder(spark))
    catalog.create_schema()
    catalog.validate_schema()
    conv = _t(spark, d, "conversations").select("conv_id").distinct()
    tenant = F.when(F.col("conv_id") % 3 == 0, None).otherwise(F.concat(F.lit("t"), F.col("conv_id") % 2))
    catalog.upsert_documents(_documents(conv.select(F.col("conv_id").cast("string").alias("doc_id"), tenant.alias("tenant_id"), F.to_json(F.struct(F.col("conv_id").alias("n"))).alias("attributes"))))
    catalog.upsert_chunks(_turns(spark, d), index=False)
    return catalog


_SPACE = Space("hash", "bow", 32)


def _even(spark, d):
    return _turns(spark, d).filter("cast(doc_id as long) % 2 = 0")


@query(f"SELECT conv_id || ':' || turn AS chunk_id FROM {_TURNS} t WHERE conv_id % 2 = 0 AND turn > 1")
def replace_chunks_removed(spark, d):
    catalog = _catalog(spark, d)
    even = _even(spark, d)
    return catalog.replace_chunks(even.select("doc_id").distinct(), even.filter("chunk_index <= 1"), index=False)


@query(f"SELECT conv_id || ':' || turn AS chunk_id, CASE WHEN turn = 0 THEN 'new' ELSE text END AS text FROM {_TURNS} t WHERE conv_id % 2 = 1 OR turn <= 1 AND (turn > 0 OR conv_id % 2 = 1) OR turn = 0")
def catalog_chunks(spark, d):
    """Chunks replaced for some documents, then some upserted: of those that come twice the last stays."""
    catalog = _catalog(spark, d)
    even = _even(spark, d)
    catalog.replace_chunks(even.select("doc_id").distinct(), even.filter("chunk_index <= 1"), index=False)
    first = _turns(spark, d).filter("chunk_index = 0")
    catalog.upsert_chunks(first.withColumn("text", F.lit("old")).unionByName(first.withColumn("text", F.lit("new"))), index=False)
    return catalog.chunks.read().select("chunk_id", "text")


@query(f"SELECT conv_id || ':' || turn AS chunk_id FROM {_TURNS} t WHERE conv_id % 3 <> 0")
def cascade_delete(spark, d):
    catalog = _catalog(spark, d)
    catalog.mark_embedded(catalog.chunks.read(), _SPACE)
    catalog.delete_documents(catalog.documents.read().filter("cast(doc_id as long) % 3 = 0").select("doc_id"))
    left = catalog.embedding_state(_SPACE)
    return left.join(catalog.chunks.read(), "chunk_id", "left_semi").join(catalog.documents.read(), F.split("chunk_id", ":")[0] == F.col("doc_id"), "left_semi").select("chunk_id")


@query(f"SELECT conv_id || ':' || turn AS chunk_id, turn = 0 AS is_stale FROM {_TURNS} t WHERE turn % 5 <> 4")
def invalidate(spark, d):
    catalog = _catalog(spark, d)
    catalog.mark_embedded(catalog.chunks.read(), _SPACE)
    catalog.invalidate(catalog.chunks.read().filter("chunk_index = 0").select("chunk_id"))
    old = catalog.stale_chunk_ids(_SPACE).withColumn("old", F.lit(True))
    return catalog.chunks.read().filter("active").join(old, "chunk_id", "left").select("chunk_id", F.col("old").isNotNull().alias("is_stale"))


@query("SELECT conv_id::VARCHAR AS doc_id, 't1' AS tenant_id FROM conversations WHERE conv_id >= 10 AND conv_id % 3 <> 0 AND conv_id % 2 = 1 GROUP BY conv_id ORDER BY conv_id::VARCHAR LIMIT 20")
def catalog_find(spark, d):
    catalog = _catalog(spark, d)
    return catalog.find({"n": {"$gte": 10}, "tenant_id": "t1"}, Scope("t1"), 20).select("doc_id", "tenant_id")


@query("SELECT pos::INTEGER AS pos, id AS chunk_id FROM (VALUES (0, '3:1'), (1, '1:0'), (3, '3:1')) v(pos, id)")
def catalog_get(spark, d):
    return _catalog(spark, d).get_chunks(["3:1", "1:0", "none", "3:1"]).select("pos", "chunk_id")


# ingestion and retrieval, from documents: whole records are chunks

_SOUND = "trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND lang IS NOT NULL"
_PROJECTED = "'Title: ' || lang || chr(10) || 'Body: ' || trim(text, ' ' || chr(9) || chr(10) || chr(13))"


def _records(spark, d, **more):
    docs = _t(spark, d, "documents").filter((T.strip(F.col("text")) != "") & F.col("lang").isNotNull())
    field = lambda label, c: F.struct(F.lit(label).alias("label"), c.alias("value"))
    fields = F.array(field("Title", F.col("lang")), field("Body", F.col("text")))
    own = F.to_json(F.struct(F.col("n_chars").alias("size"), F.col("source").alias("tenant_id"), *[v.alias(k) for k, v in more.items()]))
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), fields.alias("semantic"), own.alias("structured"), F.lit("docs").alias("source"))


def _ingested(spark, d, **options):
    at = _folder(spark)
    catalog = Catalog(spark, f"{at}/catalog")
    catalog.create_schema()
    first, second = embed.HashProvider(16), embed.HashProvider(8, model="small")
    stores = {p.space.space_id: VectorStore(spark, f"{at}/{p.space.space_id}", p.space.space_id, p.space.dimension) for p in (first, second)}
    pipeline = Pipeline(catalog, stores, first, second, **options)
    return catalog, stores, pipeline, pipeline.ingest(_records(spark, d))


@query(f"""SELECT lpad(doc_id::VARCHAR, 9, '0') || '::chunk-0000' AS id, sha256({_PROJECTED}) AS content_hash, lang AS title, n_chars AS size, 2::BIGINT AS spaces FROM documents WHERE {_SOUND}""")
def pipeline_ingest(spark, d):
    catalog, stores, pipeline, _ = _ingested(spark, d)
    states = catalog.embedded.read().groupBy("chunk_id", "content_hash").agg(F.count(F.lit(1)).alias("spaces"))
    meta = F.parse_json("metadata")
    rows = stores[pipeline.primary.space.space_id].rows().select("id", F.try_variant_get(meta, "$.title", "string").alias("title"), F.try_variant_get(meta, "$.size", "bigint").alias("size"))
    return rows.join(states, F.col("id") == F.col("chunk_id")).select("id", "content_hash", "title", "size", "spaces")


@query(f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS changed FROM documents WHERE {_SOUND})
SELECT 'first' AS step, n AS embedded, 0::BIGINT AS skipped FROM n UNION ALL SELECT 'again', 0, n FROM n UNION ALL SELECT 'metadata', changed, n - changed FROM n UNION ALL SELECT 'reembed', changed, n - changed FROM n""")
def pipeline_counts(spark, d):
    """What is embedded anew: all, nothing, those whose metadata change, and those whose ledger rows were dropped."""
    catalog, _, pipeline, first = _ingested(spark, d, fallback_mode="lazy")
    space, rows = pipeline.primary.space.space_id, []
    quarter = F.col("id").cast("long") % 4 == 0
    changed = _records(spark, d).withColumn("structured", F.when(quarter, F.to_json(F.struct(F.lit(1).alias("size")))).otherwise(F.col("structured")))
    done = [("first", first), ("again", pipeline.ingest(_records(spark, d))), ("metadata", pipeline.ingest(changed))]
    catalog.invalidate(catalog.chunks.read().filter(F.substring("chunk_id", 1, 9).cast("long") % 4 == 0).select("chunk_id"))
    done.append(("reembed", pipeline.reembed_stale(pipeline.primary)))
    rows = [(step, r.embedded[space], r.skipped[space]) for step, r in done]
    return spark.createDataFrame(rows, "step string, embedded long, skipped long")


def _found_sql(k: int) -> str:
    bm25 = _bm25_sql([(0, 0, ["anon"])], k).replace("AS terms FROM documents)", f"AS terms FROM (SELECT doc_id, {_PROJECTED} AS text FROM documents WHERE {_SOUND}))")
    return f"SELECT rank, lpad(chunk_id::VARCHAR, 9, '0') || '::chunk-0000' AS chunk_id, lpad(chunk_id::VARCHAR, 9, '0') AS doc_id, round(1.0 / (60 + rank), 9)::DOUBLE AS score FROM ({bm25})"


@query(_found_sql(10))
def retriever_lexical(spark, d):
    catalog, stores, _, _ = _ingested(spark, d, fallback_mode="off")
    hits = build(catalog, stores).retrieve({"q": "anon"}, k=10).hits
    return hits.select("rank", "chunk_id", "doc_id", F.round("score", 9).alias("score"))


class _Broken(embed.Provider):
    """Its service is down."""

    def __init__(self, space):
        self.space = space

    def embed_texts(self, texts):
        raise RuntimeError("down")


_OUTCOMES = [
    ("primary", "primary", False, False, "bow", True), ("provider fails", "openai_unavailable", True, False, "small", True), ("provider fails, no fallback", "primary", False, True, "bow", True),
    ("store fails", "openai_unavailable", True, False, "small", True), ("disabled", None, False, True, None, True), ("no lexical index", "primary", False, True, "bow", True),
]


@query(_values(_OUTCOMES, '"case", reason, fallback, degraded, model, observed'))
def retriever_outcomes(spark, d):
    """How a retrieval comes about where parts of it fail."""
    at, log = _folder(spark), LogObserver()
    catalog = Catalog(spark, f"{at}/catalog")
    catalog.create_schema()
    first, second = embed.HashProvider(16), embed.HashProvider(8, model="small")
    stores = {p.space.space_id: VectorStore(spark, f"{at}/{p.space.space_id}", p.space.space_id, p.space.dimension) for p in (first, second)}
    Pipeline(catalog, stores, first, second).ingest(spark.createDataFrame([("a", [("Body", "rotate the keys")], "{}", "a")], adapters.RECORD))
    bare = Catalog(spark, f"{at}/bare")
    bare.create_schema()

    class Lost(VectorStore):
        def rows(self):
            return super().rows().withColumn("unit", F.raise_error(F.lit("lost")).cast("array<float>"))

    sid, broken = first.space.space_id, _Broken(first.space)
    lost = stores | {sid: Lost(spark, f"{at}/{sid}", sid, 16)}
    cases = [
        ("primary", catalog, stores, Router(first, second)), ("provider fails", catalog, stores, Router(broken, second)), ("provider fails, no fallback", catalog, stores, Router(broken)),
        ("store fails", catalog, lost, Router(first, second)), ("disabled", catalog, stores, Router(first, enabled=False)), ("no lexical index", bare, stores, Router(first)),
    ]
    rows = []
    for name, cat, held, router in cases:
        r = Retriever(cat, held, router, log).retrieve("rotate")
        rows.append((name, r.provider_reason, r.fallback_occurred, r.degraded, r.model, log.rows[-1]["request_id"] == r.request_id))
    return spark.createDataFrame(rows, "case string, reason string, fallback boolean, degraded boolean, model string, observed boolean")


# sources


def _write_files(rows, at: str):
    """rows (name, text) -> that many files below a folder."""

    def run(it):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(at)
        made = set()
        for batch in it:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                path = f"{base}/{name}"
                if (parent := path.rpartition("/")[0]) not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                with files.open_output_stream(path) as out:
                    out.write(text.encode())
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    rows.select("name", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


def _write_lines(rows, at: str, ends: dict[str, tuple[str, str, str]]):
    """rows (name, line) -> a file for each name, below a folder, with its lines in some order. ends: by a name's ending,
    what stands before, between and behind the lines. Tasks write pieces, which are then strung together as streams, so
    nobody holds a file."""

    def pieces(it):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(at)
        files.create_dir(f"{base}/_pieces", recursive=True)
        out = {}
        try:
            for batch in it:
                for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist()):
                    if name not in out:
                        piece = f"_pieces/{uuid.uuid4().hex}"
                        out[name] = piece, files.open_output_stream(f"{base}/{piece}", buffer_size=1 << 20)
                    else:
                        out[name][1].write(ends[name.rpartition(".")[2]][1].encode())
                    out[name][1].write(line.encode())
        finally:
            for _, stream in out.values():
                stream.close()
        yield pa.record_batch([pa.array(list(out), pa.string()), pa.array([p for p, _ in out.values()], pa.string())], names=["name", "piece"])

    def joined(it):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(at)
        for batch in it:
            for row in batch.to_pylist():
                before, between, behind = (x.encode() for x in ends[row["name"].rpartition(".")[2]])
                with files.open_output_stream(f"{base}/{row['name']}", buffer_size=1 << 20) as out:
                    out.write(before)
                    for i, piece in enumerate(row["pieces"]):
                        out.write(between if i else b"")
                        with files.open_input_stream(f"{base}/{piece}") as part:
                            while block := part.read(1 << 20):
                                out.write(block)
                    out.write(behind)
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    made = rows.select("name", "line").mapInArrow(pieces, "name string, piece string").collect()  # a row for each task and name
    by: dict[str, list] = {}
    for r in made:
        by.setdefault(r.name, []).append(r.piece)
    if by:
        spark = rows.sparkSession
        lists = spark.createDataFrame(sorted(by.items()), "name string, pieces array<string>").repartition(len(by))
        lists.mapInArrow(joined, "n long").agg(F.sum("n")).collect()
        pieces_at = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_pieces")
        pieces_at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(pieces_at, True)
    return at


@query("SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, lang AS title, n_chars AS size, source || '/' || doc_id || '.md' AS source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
def markdown_files(spark, d):
    docs = _t(spark, d, "documents").filter("lang is not null and source is not null and text is not null")
    text = F.format_string("---\ndoc_id: '%09d'\ntitle: %s\nsize: %d\n---\n# Heading\n%s", "doc_id", "lang", "n_chars", "text")
    at = _write_files(docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("name"), text.alias("text")), _folder(spark))
    got = adapters.read(spark, at, "markdown")
    return got.select("id", F.element_at("semantic", 1)["value"].alias("title"), F.try_variant_get(F.parse_json("structured"), "$.size", "bigint").alias("size"), "source")


@query("SELECT doc_id::VARCHAR AS id, 1 + (trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '')::INTEGER AS fields, n_chars AS size, 'part-' || doc_id % 4 || '.csv' AS source FROM documents")
def csv_files(spark, d):
    docs = _t(spark, d, "documents")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.coalesce("lang", F.lit("none"))), quoted(F.col("text")), F.col("n_chars").cast("string"))
    lines = docs.select(F.format_string("part-%d.csv", F.col("doc_id") % 4).alias("name"), line.alias("line"))
    at = _write_lines(lines, _folder(spark), {"csv": ("Record ID,Title,Text,Size\n", "\n", "")})
    got = adapters.read(spark, at, "csv")
    return got.select("id", F.size("semantic").alias("fields"), F.try_variant_get(F.parse_json("structured"), "$.Size", "bigint").alias("size"), "source")


@query("SELECT doc_id::VARCHAR AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body, n_chars AS size FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def json_files(spark, d):
    docs = _t(spark, d, "documents").filter(T.strip(F.col("text")) != "")
    line = F.to_json(F.struct(F.col("doc_id"), F.col("text").alias("body"), F.col("n_chars").alias("size"), F.array("lang").alias("nested")))
    name = F.format_string("%d.%s", F.col("doc_id") % 8, F.when(F.col("doc_id") % 2 == 0, "jsonl").otherwise("json"))
    ends = {"jsonl": ("", "\n\n", ""), "json": ('{"records": [', ",", "]}")}
    got = adapters.read(spark, _write_lines(docs.select(name.alias("name"), line.alias("line")), _folder(spark), ends), "json", semantic=["body"])
    return got.select("id", T.strip(F.element_at("semantic", 1)["value"]).alias("body"), F.try_variant_get(F.parse_json("structured"), "$.size", "bigint").alias("size"))


# routing, budgets and refusals


class _Clock:
    def __init__(self):
        from datetime import UTC, datetime

        self.at = datetime(2026, 3, 30, 12, tzinfo=UTC)

    def __call__(self):
        return self.at

    def later(self, **by):
        from datetime import timedelta

        self.at += timedelta(**by)


_ROUTES = [
    ("nothing in the way", "primary"), ("override", "manual_override"), ("disabled", "openai_disabled"), ("disabled, no fallback", "no provider"), ("three failures", "openai_unavailable"),
    ("after the cooldown", "primary"), ("rate limited", "openai_rate_limited"), ("after the backoff", "primary"), ("day's budget met exactly", "primary"), ("day's budget passed", "budget_daily_exceeded"),
    ("next day", "primary"), ("month's budget passed", "budget_monthly_exceeded"), ("forced beyond the budget", "manual_override"), ("budget without a price", "no price"), ("budget without tokens", "refused"),
]


@query(_values([(a.replace("'", "''"), b) for a, b in _ROUTES], '"case", outcome'))
def router_reasons(spark, d):
    clock = _Clock()
    first, second = embed.HashProvider(16), embed.HashProvider(8, model="small")

    def router(fallback=second, **options):
        return Router(first, fallback, **{"ledger": Ledger(now=clock), "breaker": Breaker(now=clock), "usd_per_million": "1"} | options)

    def outcome(r, tokens=2):
        try:
            return str(r.select(estimated_tokens=tokens).reason)
        except NoProvider:
            return "no provider"
        except ValueError:
            return "refused"

    out = [outcome(router()), outcome(router(override="force_fallback")), outcome(router(enabled=False)), outcome(router(None, enabled=False))]
    r = router()
    for _ in range(3):
        r.record_failure()
    out.append(outcome(r))
    clock.later(seconds=60)
    out.append(outcome(r))
    r.record_rate_limit(5)
    out.append(outcome(r))
    clock.later(seconds=5)
    out.append(outcome(r))
    r = router(daily_usd="0.000004", monthly_usd="0.000007")
    held = r.select(estimated_tokens=4)
    r.record_usage(4, reservation=held.reservation)
    out += [str(held.reason), outcome(r, 1)]
    clock.later(days=1)
    out += [outcome(r, 3), outcome(r, 1)]
    out.append(str(router(override="force_primary", daily_usd="0").select(estimated_tokens=9).reason))
    try:
        router(usd_per_million=None, daily_usd="1")
    except PricingUnavailable:
        out.append("no price")
    out.append(outcome(router(daily_usd="1"), None))
    return spark.createDataFrame([(name, got) for (name, _), got in zip(_ROUTES, out)], "case string, outcome string")


@query("SELECT status, tokens::BIGINT AS tokens, nanos::BIGINT AS nanos FROM (VALUES ('committed', 7, 140), ('released', 50, 1000), ('expired', 5, 100), ('reserved', 9, 180), ('committed', 100, 1234)) v(status, tokens, nanos)")
def ledger_events(spark, d):
    """A reservation that is committed, one released, one that expires, one open, and a total that was stated."""
    clock = _Clock()
    ledger = Ledger(now=clock)
    r = Router(embed.HashProvider(16), ledger=ledger, usd_per_million="0.02", daily_usd="1")
    r.record_usage(7, reservation=r.select(estimated_tokens=10).reservation)
    r.record_failure(r.select(estimated_tokens=50).reservation)
    r.select(estimated_tokens=5)
    clock.later(seconds=300)
    r.select(estimated_tokens=9)
    ledger.record(Charge.total("hash", "bow", "standard", 100, "0.000001234"))
    return ledger.events_frame(spark).select("status", "tokens", F.col("charge_nanos").alias("nanos"))


def _refused(case) -> bool:
    try:
        case()
    except (ValueError, SourceError, LexicalUnavailable, KeyError):
        return True
    return False


_REFUSALS = [
    "empty filter key", "empty condition", "unknown operator", "$in of text", "empty $in", "text range of an attribute", "window of no words", "overlap as wide as the window", "missing lexical index",
    "unknown store", "store without a name", "store of another width", "query of another width", "index of another space", "space without letters", "blank scope", "input beyond a request", "too few vectors", "vectors too short",
    "chunk without text", "duplicate record", "chunk of no document", "limit of 0", "blank query", "other schema",
]


@query(_values([(x, True) for x in _REFUSALS], '"case", refused'))
def refusals(spark, d):
    """What the engine must turn down, and does."""
    at = _folder(spark)
    catalog = Catalog(spark, at)
    catalog.create_schema()
    frame = spark.createDataFrame
    provider = embed.HashProvider(16)
    store = VectorStore(spark, f"{at}/v", provider.space.space_id, 16)
    chunk = lambda doc, text: frame([("c", doc, text, 0)], "chunk_id string, doc_id string, text string, chunk_index int")
    filters = lambda where: lambda: compile_filter(where, {"id": (F.col("id"), "number")}, F.parse_json(F.lit("{}")))
    record = ("a", [("Body", "text")], "{}", "s")

    class Few(embed.HashProvider):
        def embed_texts(self, texts):
            return super().embed_texts(texts)[1:]

    class Short(embed.HashProvider):
        def embed_texts(self, texts):
            return [v[1:] for v in super().embed_texts(texts)]

    def other_schema():
        frame([(1,)], "x int").write.mode("overwrite").parquet(f"{catalog.documents.path}/{catalog.documents.version()}")
        catalog.validate_schema()

    cases = [
        filters({"": 1}), filters({"id": {}}), filters({"id": {"$ne": 1}}), filters({"id": {"$in": "ab"}}), filters({"id": {"$in": []}}), filters({"other": {"$gt": "a"}}),
        lambda: chunking.check_window(0, 0), lambda: chunking.check_window(5, 5), lambda: lexical.read(spark, f"{at}/none"), lambda: create_store("none"), lambda: create_store(""),
        lambda: Pipeline(catalog, {provider.space.space_id: VectorStore(spark, f"{at}/w", provider.space.space_id, 8)}, provider), lambda: store.search([1.0], 1), lambda: VectorIndex(embed.HashProvider(8), store),
        lambda: Space("--", "m", 1), lambda: Scope(" "), lambda: list(embed.requests([9000])), lambda: embed.checked(Few(16), ["a", "b"]), lambda: embed.checked(Short(16), ["a"]),
        lambda: catalog.upsert_chunks(chunk("a", " ")), lambda: Pipeline(catalog, {provider.space.space_id: store}, provider).ingest(frame([record, record], adapters.RECORD)), lambda: catalog.upsert_chunks(chunk("none", "text")),
        lambda: catalog.find(limit=0), lambda: Retriever(catalog).retrieve(" "), other_schema,
    ]
    return frame([(name, _refused(case)) for name, case in zip(_REFUSALS, cases)], "case string, refused boolean")


@query("SELECT i::INTEGER AS request, n::INTEGER AS inputs FROM (VALUES (0, 3), (1, 1), (2, 2), (3, 1)) v(i, n)")
def embed_requests(spark, d):
    """Inputs that a client is asked for at once: three at most, and 300,000 tokens; answers come in any order."""
    sizes = [8000 * 4 - 3] * 7
    asked = []

    class Client:
        class embeddings:  # noqa: N801 - the client's own name
            @staticmethod
            def create(model, input):  # noqa: A002
                from types import SimpleNamespace as N

                asked.append(len(input))
                return N(data=[N(index=i, embedding=[float(len(t))]) for i, t in reversed(list(enumerate(input)))], usage=N(total_tokens=len(input)))

    provider = embed.OpenAIProvider(client=Client, batch_size=3)
    texts = ["x" * n for n in sizes[:3]] + ["y"] + ["z"] * 3
    limits = list(embed.requests([100_000] * 3 + [250_000] + [150_000] * 3, 3, 300_000, 300_000))
    vectors, used = provider.embed_texts_with_usage(texts)
    sound = [v[0] for v in vectors] == [float(len(t)) for t in texts] and used == 7 and asked == [3, 3, 1]
    return spark.createDataFrame([(i, len(r) if sound else -1) for i, r in enumerate(limits)], "request int, inputs int")
