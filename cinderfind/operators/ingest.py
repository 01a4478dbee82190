"""Ingestion: records become documents, chunks and vectors, incrementally, catalog before vectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfind.functions import text as T
from cinderfind.model import DOCUMENT_COLUMNS, DOCUMENTS, NoProvider
from cinderfind.operators import chunking
from cinderfind.operators.embed import BATCH, embed
from cinderfind.sources.catalog import Catalog, changed, stale
from cinderfind.sources.stores import VectorStore
from cinderfind.sources.tables import duplicate_keys, staged

RESERVED = set(DOCUMENT_COLUMNS)


def documents_of(records: DataFrame) -> DataFrame:
    """Records -> catalog documents: known structured fields become columns, the rest attributes. The record's id and
    source win over structured ones; a missing title is the semantic one."""
    v = F.parse_json("structured")
    known = [F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in DOCUMENT_COLUMNS if c not in ("doc_id", "title", "source")]
    titled = F.filter("semantic", lambda f: F.lower(f["label"]) == "title")
    title = F.coalesce(F.try_variant_get(v, "$.title", "string"), F.when(F.size(titled) > 0, F.element_at(titled, 1)["value"]))
    source = F.coalesce("source", F.try_variant_get(v, "$.source", "string"))
    out = records.select(F.col("id").alias("doc_id"), title.alias("title"), source.alias("source"), *known, "structured")
    return out.withColumn("attributes", _without(F.col("structured"), RESERVED)).select(*DOCUMENTS.names)


def _without(json_text, names):
    """A JSON object's text less some of its keys; values keep their types."""
    entries = F.map_filter(F.from_json(json_text, "map<string,variant>"), lambda k, v: ~k.isin(*names))
    return F.to_json(entries)


def chunks_of(records: DataFrame, chunker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records -> catalog chunks; whole records by default. chunker takes (doc_id, text, title, body) and returns
    (doc_id, chunk_id, chunk_index, text[, section_path]). text is the projection; body the semantic field of that name,
    or content or text, or else the projection; title the structured or semantic one, or else the id."""
    text = T.semantic_projection(F.col("semantic"))
    field = lambda *names: F.element_at(F.filter("semantic", lambda f: F.lower(f["label"]).isin(*names)), 1)["value"]
    first = lambda *names: F.when(F.exists("semantic", lambda f: F.lower(f["label"]).isin(*names)), field(*names))
    title = F.coalesce(F.try_variant_get(F.parse_json("structured"), "$.title", "string"), first("title"), F.col("id"))
    projected = records.select(F.col("id").alias("doc_id"), text.alias("text"), title.alias("title"), F.coalesce(first("body", "content", "text"), text).alias("body"))
    cut = (chunker or chunking.whole)(projected)
    if "section_path" not in cut.columns:
        cut = cut.withColumn("section_path", F.lit(None).cast("string"))
    return cut.select("chunk_id", "doc_id", "text", "chunk_index", "section_path", T.content_hash(F.col("text")).alias("content_hash"), F.lit(True).alias("active"))


def vector_rows(chunks: DataFrame, documents: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, text, metadata, content_hash): metadata is attributes, document columns that aren't null, and the chunk's place.
    only (chunk_id, doc_id): these chunks alone; their documents are joined before texts are."""
    d = documents.select("doc_id", "attributes", *[F.col(c).alias(f"_{c}") for c in DOCUMENT_COLUMNS])
    both = chunks.join(d, "doc_id") if only is None else chunks.drop("doc_id").join(only.select("chunk_id", "doc_id").join(d, "doc_id"), "chunk_id")
    plain = F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in DOCUMENT_COLUMNS], "chunk_index", "section_path"))
    merged = F.to_json(F.map_concat(_less(F.coalesce("attributes", F.lit("{}"))), F.from_json(plain, "map<string,variant>")))
    return both.select(F.col("chunk_id").alias("id"), "text", merged.alias("metadata"), "content_hash")


def _less(attributes):
    return F.map_filter(F.from_json(attributes, "map<string,variant>"), lambda k, v: ~k.isin(*RESERVED, "chunk_index", "section_path"))


@dataclass
class Ingested:
    documents: int
    chunks: int
    removed: int
    embedded: dict = field(default_factory=dict)
    skipped: dict = field(default_factory=dict)
    errors: list = field(default_factory=list)


class Pipeline:
    """One ingest is a handful of Spark jobs over whole sets: no driver loop over records. A router, if there is one,
    decides once for all stale chunks of the primary space, with their tokens summed by Spark."""

    def __init__(self, catalog: Catalog, stores: dict[str, VectorStore], primary, fallback=None, router=None, chunker=None, fallback_mode: str = "eager", require_primary: bool = False, batch_size: int = BATCH):
        if fallback_mode not in ("eager", "lazy", "off"):
            raise ValueError("fallback_mode is eager, lazy or off")
        if type(batch_size) is not int or batch_size < 1:
            raise ValueError("batch_size is positive")
        for p in filter(None, (primary, fallback)):
            store = stores.get(p.space.space_id)
            if store is not None and store.dimension != p.space.dimension:
                raise ValueError(f"the store of {p.space.space_id} has another dimension")
        self.catalog, self.stores, self.primary, self.fallback, self.router = catalog, stores, primary, fallback, router
        self.chunker, self.fallback_mode, self.require_primary, self.batch_size = chunker, fallback_mode, require_primary, batch_size

    def ingest(self, records: DataFrame) -> Ingested:
        if not duplicate_keys(records, ["id"]).isEmpty():
            raise ValueError("a record's id comes twice")
        catalog = self.catalog
        docs = staged(catalog.spark, catalog.documents.path, documents_of(records))
        chunks, ids = chunks_of(records, self.chunker), docs.select("doc_id")
        if self.chunker is not None:
            chunks = staged(catalog.spark, catalog.chunks.path, chunks)
        if not duplicate_keys(chunks, ["chunk_id"]).isEmpty():
            raise ValueError("a chunk's id comes twice")
        # what a changed document says of its chunks is old in every space, also where their text stays
        before = catalog.documents.read()
        other = staged(catalog.spark, catalog.documents.path, changed(before, docs))
        touched = catalog.chunks.read().join(other, "doc_id", "left_semi").select("chunk_id")
        touched = staged(catalog.spark, catalog.chunks.path, touched)
        if not touched.isEmpty():
            catalog.invalidate(touched)
            for store in self.stores.values():
                store.delete(touched.withColumnRenamed("chunk_id", "id"))
        fresh = ids.join(before, "doc_id", "left_anti").union(other)
        fresh = staged(catalog.spark, catalog.documents.path, docs.join(fresh, "doc_id", "left_semi"))
        if not fresh.isEmpty():
            catalog.documents.upsert(fresh, unique=True)
        removed = catalog.replace_chunks(ids, chunks)
        out = Ingested(docs.count(), catalog.chunks.read().join(ids, "doc_id", "left_semi").count(), removed.count())
        if out.removed:
            for store in self.stores.values():
                store.delete(removed.withColumnRenamed("chunk_id", "id"))
        self._embed(self.primary, ids, out, routed=True)
        if self.fallback is not None and self.fallback_mode == "eager":
            self._embed(self.fallback, ids, out, routed=False)
        return out

    def reembed_stale(self, provider) -> Ingested:
        """Embeds what is stale in a provider's space, over the whole catalog."""
        out = Ingested(0, 0, 0)
        self._embed(provider, None, out, routed=provider is self.primary)
        return out

    def _embed(self, provider, ids: DataFrame | None, out: Ingested, routed: bool) -> None:
        catalog, space = self.catalog, provider.space
        active = catalog.chunks.read().filter("active")
        keys = active.select("chunk_id", "doc_id", "content_hash", "active")
        if ids is not None:
            keys = keys.join(ids, "doc_id", "left_semi")
        # what is stale is a table of keys; texts are joined once it is known
        old = staged(catalog.spark, catalog.chunks.path, stale(keys, catalog.embedded.read(), space, full=True).select("chunk_id", "doc_id", "content_hash"))
        n, total = old.count(), keys.count()
        out.embedded[space.space_id], out.skipped[space.space_id] = 0, total - n
        if not n:
            return
        selection = None
        if routed and self.router is not None:
            tokens = active.join(old.select("chunk_id"), "chunk_id", "left_semi").agg(F.sum(T.estimate_tokens(F.col("text")))).first()[0]
            try:
                selection = self.router.select("ingest", estimated_tokens=int(tokens))
            except NoProvider as e:
                out.errors.append(str(e))
                selection = None
            if selection is None or selection.provider is not provider:
                if self.require_primary:
                    raise RuntimeError("the primary provider was turned down, and ingestion requires it")
                return
        store = self.stores[space.space_id]
        try:
            # a version of the store's own: the model runs once, however often its rows are read
            name = store.prepared(embed(vector_rows(active, catalog.documents.read(), old), provider, batch=self.batch_size))
        except Exception:
            if selection is not None:
                self.router.record_failure(selection.reservation)
            if self.require_primary or not routed:
                raise
            out.errors.append(f"embedding failed in {space.space_id}")
            return
        if selection is not None:
            self.router.record_usage(int(tokens), reservation=selection.reservation)
        made = old.join(catalog.documents.read().select("doc_id"), "doc_id", "left_semi")
        store.adopt(name, made.select(F.col("chunk_id").alias("id")))
        catalog.mark_embedded(made, space, unique=True)
        out.embedded[space.space_id] = n
