"""The document catalog: documents, chunks, the embedding ledger and the lexical index, as snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfind.functions.text import content_hash
from cinderfind.model import CHUNKS, DOCUMENT_COLUMNS, DOCUMENTS, EMBEDDED, LexicalUnavailable, Scope, Space
from cinderfind.operators import lexical
from cinderfind.plans.filters import compile_filter, compile_scope
from cinderfind.sources.tables import Table, duplicate_keys, last_wins, staged, upserted


def predicate(where: dict | None, scope: Scope | None, attributes: str = "attributes") -> Column:
    """A filter and a scope over rows that have the document columns and attributes as JSON text."""
    columns = {c: (F.col(c), "text") for c in DOCUMENT_COLUMNS}
    return compile_filter(where, columns, F.try_parse_json(attributes)) & compile_scope(scope, F.col("tenant_id"), F.col("visibility"))


def find(documents: DataFrame, where: dict | None = None, scope: Scope | None = None, limit: int = 100) -> DataFrame:
    """Documents that match, by doc_id, limit at most."""
    if limit < 1:
        raise ValueError("limit is positive")
    return documents.filter(predicate(where, scope)).orderBy("doc_id").limit(limit)


def get_in_order(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows of ids in that order with pos; unknown ids are skipped, repeated ones repeated."""
    kind = dict(rows.dtypes)[key]
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} {kind}")
    return rows.join(F.broadcast(wanted), key).orderBy("pos")


def stale(chunks: DataFrame, embedded: DataFrame, space: Space, full: bool = False) -> DataFrame:
    """Active chunks whose text isn't embedded in the space as it is now. full also compares the space's identity."""
    state = embedded.filter(F.col("space_id") == space.space_id).select("chunk_id", F.col("content_hash").alias("_hash"), "provider", "model", "dimension", "version")
    old = ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    if full:
        for name in ("provider", "model", "dimension", "version"):
            old = old | ~F.col(name).eqNullSafe(F.lit(getattr(space, name)))
    return chunks.filter("active").join(state, "chunk_id", "left").filter(old).select(*chunks.columns)


def changed(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of rows that both have and that differ in any column of new."""
    rest = [c for c in new.columns if c != key]
    a, b = old.select(key, F.struct(*rest).alias("_a")), new.select(key, F.struct(*rest).alias("_b"))
    return a.join(b, key).filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


class Catalog:
    """Tables below one path. Mutations commit table by table, catalog before vectors, so a broken run can be repaired."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.documents = Table(spark, f"{path}/documents", DOCUMENTS, ["doc_id"])
        self.chunks = Table(spark, f"{path}/chunks", CHUNKS, ["chunk_id"])
        self.embedded = Table(spark, f"{path}/chunk_embeddings", EMBEDDED, ["chunk_id", "space_id"])

    def create_schema(self) -> None:
        for t in (self.documents, self.chunks, self.embedded):
            if t.version() is None:
                t.commit(self.spark.createDataFrame([], t.schema))

    def validate_schema(self) -> None:
        for t in (self.documents, self.chunks, self.embedded):
            found = self.spark.read.parquet(f"{t.path}/{t.version()}").schema
            kinds = lambda s: {(f.name, f.dataType.simpleString()) for f in s}
            if kinds(found) != kinds(t.schema):
                raise ValueError(f"{t.path} hasn't the schema that is expected")

    def upsert_documents(self, rows: DataFrame, order: str | None = None) -> None:
        self.documents.upsert(rows, order)

    def upsert_chunks(self, rows: DataFrame, order: str | None = None, index: bool = True) -> None:
        """Chunks of documents that are there; the lexical index follows. One bad row and nothing changes."""
        rows = self._sound(rows)
        orphans = rows.join(self.documents.read(), "doc_id", "left_anti")
        if not orphans.isEmpty():
            raise ValueError("a chunk's document isn't in the catalog")
        self.chunks.upsert(rows, order)
        if index:
            self.reindex()

    def _sound(self, rows: DataFrame) -> DataFrame:
        rows = self._defaults(rows)
        self._check(rows)
        return rows

    def _defaults(self, rows: DataFrame) -> DataFrame:
        for name, default in (("section_path", F.lit(None).cast("string")), ("content_hash", content_hash(F.col("text"))), ("active", F.lit(True))):
            if name not in rows.columns:
                rows = rows.withColumn(name, default)
        return rows

    def _check(self, rows: DataFrame) -> None:
        bad = rows.filter("chunk_id is null or chunk_id = '' or text is null or trim(text) = '' or chunk_index < 0")
        if not bad.isEmpty():
            raise ValueError("a chunk has no id, no text or a negative index")

    def replace_chunks(self, docs: DataFrame, rows: DataFrame, index: bool = True) -> DataFrame:
        """Puts rows in place of all chunks of docs (doc_id), and returns the removed chunk_ids, sorted. Chunks that
        stay keep their ledger rows; those of removed ones go."""
        name, rows = self.chunks.prepared(self._defaults(rows))  # made once, and the new version as it is if there was nothing before
        self._check(rows)
        if not rows.join(docs, "doc_id", "left_anti").isEmpty():
            raise ValueError("a chunk is of another document")
        if not duplicate_keys(rows, ["chunk_id"]).isEmpty():
            raise ValueError("a chunk id comes twice")
        old = self.chunks.read()
        gone = old.join(docs, "doc_id", "left_semi").join(rows.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
        removed = staged(self.spark, self.chunks.path, gone).orderBy("chunk_id")
        if old.isEmpty():
            self.chunks.adopt(name)
        else:
            self._replace(old, rows, removed, name)
        if not removed.isEmpty():
            self.embedded.delete(removed)
        if index and self._indexed() != self.chunks.version():
            self.reindex()
        return removed

    def _replace(self, old: DataFrame, rows: DataFrame, removed: DataFrame, name: str) -> None:
        """Commits rows, prepared as name, in place of old ones; where none is new, other or gone, the version stays."""
        state = lambda t: t.select("chunk_id", F.struct("doc_id", "chunk_index", "section_path", "content_hash", "active", F.sha2("text", 256)).alias("state"))
        both = state(rows).join(state(old).withColumnRenamed("state", "before"), "chunk_id", "left")
        fresh = staged(self.spark, self.chunks.path, both.filter(~F.col("state").eqNullSafe(F.col("before"))).select("chunk_id"))
        if fresh.isEmpty() and removed.isEmpty():
            self.chunks.discard(name)
            return
        rest = staged(self.spark, self.chunks.path, old.select("chunk_id").join(rows.select("chunk_id").union(removed), "chunk_id", "left_anti"))
        self.chunks.adopt(name, None if rest.isEmpty() else old.join(rest, "chunk_id", "left_semi"))

    def delete_documents(self, ids: DataFrame) -> None:
        """With their chunks and those chunks' ledger rows."""
        gone = staged(self.spark, self.chunks.path, self.chunks.read().join(ids, "doc_id", "left_semi").select("chunk_id"))
        self.embedded.delete(gone)
        self.chunks.delete(ids.select("doc_id"))
        self.documents.delete(ids.select("doc_id"))
        self.reindex()

    def mark_embedded(self, chunks: DataFrame, space: Space, unique: bool = False) -> None:
        """chunks (chunk_id, content_hash) are embedded in the space. unique: no chunk_id comes twice."""
        s = F.lit
        rows = chunks.select("chunk_id", s(space.space_id).alias("space_id"), s(space.provider).alias("provider"), s(space.model).alias("model"), s(space.dimension).alias("dimension"), s(space.version).alias("version"), "content_hash", F.current_timestamp().alias("created_at"))
        self.embedded.upsert(rows, unique=unique)

    def invalidate(self, ids: DataFrame) -> None:
        """Forgets that chunks (chunk_id) are embedded, in every space."""
        self.embedded.delete(ids.select("chunk_id"))

    def embedding_state(self, space: Space, ids: list[str] | None = None) -> DataFrame:
        """Ledger rows of a space; None: of all chunks, an empty list: of none."""
        rows = self.embedded.read().filter(F.col("space_id") == space.space_id)
        return rows if ids is None else rows.filter(F.col("chunk_id").isin(list(ids))) if ids else rows.limit(0)

    def stale_chunk_ids(self, space: Space) -> DataFrame:
        return stale(self.chunks.read(), self.embedded.read(), space).select("chunk_id").orderBy("chunk_id")

    def find(self, where: dict | None = None, scope: Scope | None = None, limit: int = 100) -> DataFrame:
        return find(self.documents.read(), where, scope, limit)

    def get_chunks(self, ids: list[str]) -> DataFrame:
        return get_in_order(self.chunks.read(), ids, "chunk_id")

    def reindex(self) -> None:
        """Writes the lexical index of all chunks, active or not."""
        fs, mark = self.chunks._fs(f"{self.path}/lexical/_CHUNKS")
        fs.delete(mark, False)
        version = self.chunks.version()
        lexical.write(lexical.build(self.chunks.read()), f"{self.path}/lexical")
        out = fs.create(mark, True)
        out.write(bytearray((version or "").encode()))
        out.close()

    def _indexed(self) -> str | None:
        """The version of the chunks that the lexical index is of."""
        return self.chunks.text(f"{self.path}/lexical/_CHUNKS")

    def search_lexical(self, queries: DataFrame, k: int = 10, where: dict | None = None, scope: Scope | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for (query_id, text): active chunks of documents in filter and scope."""
        units = lexical.plain_units(queries)
        index = lexical.pruned(lexical.read(self.spark, f"{self.path}/lexical"), units)
        docs = self.documents.read().filter(predicate(where, scope)).select("doc_id")
        eligible = self.chunks.read().filter("active").join(docs, "doc_id", "left_semi")
        return lexical.search(index, units, k, eligible)


__all__ = ["Catalog", "LexicalUnavailable", "changed", "find", "get_in_order", "last_wins", "predicate", "stale", "upserted"]
