"""Hybrid retrieval of whole batches of queries: dense and lexical candidates, fused, cut to k, and hydrated."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfind.functions import vectors as V
from cinderfind.model import LexicalUnavailable, NoProvider, Scope
from cinderfind.operators.fusion import rrf, top
from cinderfind.plans.analyze import analyze
from cinderfind.plans.filters import compile_filter, merge_scope
from cinderfind.plans.observe import notify
from cinderfind.plans.policy import Reason, Selection


@dataclass(frozen=True)
class Config:
    dense: bool = True
    lexical: bool = True
    dense_k: int = 50
    lexical_k: int = 50
    k: int = 10
    rrf_k: int = 60
    lexical_boost: float = 2.0
    active_only: bool = False

    def __post_init__(self):
        for name in ("dense_k", "lexical_k", "k", "rrf_k"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ValueError(f"{name} is a positive whole number")


@dataclass
class Result:
    """hits (query_id, rank, chunk_id, doc_id, text, score, dense_rank, dense_score, lexical_rank, lexical_score) and
    how they came about. Query texts aren't kept."""

    hits: DataFrame
    request_id: str
    n_queries: int
    space_id: str | None
    provider: str | None
    provider_reason: str | None
    model: str | None
    fallback_occurred: bool
    degraded: bool
    dense_k: int
    lexical_k: int
    k: int
    filters: int
    scope_tenant: str | None
    input_tokens: int | None
    estimated_usd: float | None
    dense_backend: str | None
    lexical_backend: str | None
    errors: tuple[str, ...] = ()
    timings: dict = field(default_factory=dict)
    fusion: str = "rrf"

    def provenance(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "hits"}


def fuse(dense: DataFrame, lexical: DataFrame, weights: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """dense and lexical (query_id, id, score, rank), weights (query_id, dense_weight, lexical_weight) -> each query's
    k best with the ranks and scores of both signals. A signal's own score is shown, never added."""
    parts = [(dense, "dense"), (lexical, "lexical")]
    weighed = [df.join(F.broadcast(weights), "query_id").select("query_id", "id", F.col("rank").alias("position"), f"{name}_weight") for df, name in parts]
    best = top(rrf(weighed, [F.col("dense_weight"), F.col("lexical_weight")], rrf_k), k)
    for df, name in parts:
        own = df.groupBy("query_id", "id").agg(F.min("rank").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score"))
        best = best.join(own, ["query_id", "id"], "left")
    return best


class Retriever:
    """catalog serves structured and lexical search, stores by space id the dense one; without a router, or a store
    for its choice, lexical search serves alone. A failing primary gives way to the fallback in the same request,
    never the other way round."""

    def __init__(self, catalog, stores: dict | None = None, router=None, observer=None, config: Config | None = None):
        self.catalog, self.stores, self.router, self.observer, self.config = catalog, stores or {}, router, observer, config or Config()
        if router is not None:
            for p in filter(None, (router.primary, router.fallback)):
                store = self.stores.get(p.space.space_id)
                if store is not None and store.dimension != p.space.dimension:
                    raise ValueError(f"the store of {p.space.space_id} has another dimension")

    def find(self, where: dict | None = None, scope: Scope | None = None, limit: int = 100) -> DataFrame:
        return self.catalog.find(where, scope, limit)

    def retrieve(self, queries, where: dict | None = None, scope: Scope | None = None, k: int | None = None) -> Result:
        """queries: one text, or {query_id: text}. Scope and filter hold while candidates are found, on both sides."""
        texts = {"q": queries} if isinstance(queries, str) else dict(queries)
        if not texts or any(not isinstance(t, str) or not t.strip() for t in texts.values()):
            raise ValueError("a query is blank; find() serves filters alone")
        k = self.config.k if k is None else k
        if type(k) is not int or k < 1:
            raise ValueError("k is positive")
        spark, started, timings, errors = self.catalog.spark, time.perf_counter(), {}, []
        frame = spark.createDataFrame(list(texts.items()), "query_id string, text string")
        profile = analyze(frame, lexical_boost=self.config.lexical_boost).select("query_id", "dense_weight", "lexical_weight")
        empty = spark.createDataFrame([], "query_id string, id string, score double, rank int")

        wanted = self.config.dense and self.router is not None and bool(self.stores)
        dense, chosen, fell, usage = (None, None, False, None)
        if wanted:
            dense, chosen, fell, usage = self._dense(texts, merge_scope(where, scope), errors, timings)
        lexical, failed = None, False
        if self.config.lexical:
            at = time.perf_counter()
            try:
                lexical = self.catalog.search_lexical(frame, self.config.lexical_k, where, scope).withColumnRenamed("chunk_id", "id")
            except LexicalUnavailable as e:
                failed = True
                errors.append(f"lexical unavailable: {e}")
            timings["lexical_search"] = (time.perf_counter() - at) * 1000
        at = time.perf_counter()
        hits = fuse(empty if dense is None else dense, empty if lexical is None else lexical, profile, k, self.config.rrf_k)
        chunks = self.catalog.chunks.read()
        if self.config.active_only:
            chunks = chunks.filter("active")
        # hydration comes after the cut: what isn't in the catalog any more leaves a gap
        hits = hits.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id", "text", "section_path"), "id")
        hits = hits.select("query_id", "rank", F.col("id").alias("chunk_id"), "doc_id", "section_path", "text", "score", "dense_rank", "dense_score", "lexical_rank", "lexical_score")
        timings["fusion"] = (time.perf_counter() - at) * 1000
        timings["total"] = (time.perf_counter() - started) * 1000
        space = chosen.space if chosen else None
        tokens, usd = usage or (None, None)
        result = Result(
            hits=hits, request_id=uuid.uuid4().hex, n_queries=len(texts), provider=space and space.provider, model=space and space.model, space_id=space and space.space_id,
            provider_reason=str(chosen.reason) if chosen else None, fallback_occurred=fell, degraded=(wanted and dense is None) or failed,
            dense_k=self.config.dense_k if self.config.dense else 0, lexical_k=self.config.lexical_k if self.config.lexical else 0, k=k,
            filters=len(where or {}), scope_tenant=scope.tenant_id if scope else None, input_tokens=tokens, estimated_usd=usd,
            dense_backend="table" if dense is not None else None, lexical_backend="bm25" if self.config.lexical else None, errors=tuple(errors), timings=timings,
        )
        notify(self.observer, result)
        return result

    def _dense(self, texts: dict, where: dict | None, errors: list, timings: dict):
        router = self.router
        try:
            chosen = router.select("query", texts=list(texts.values()))
        except (NoProvider, ValueError) as e:
            errors.append(f"dense unavailable: {e}")
            return None, None, False, None
        options = [chosen]
        if chosen.provider is router.primary and router.fallback is not None:
            options.append(Selection(router.fallback, Reason.UNAVAILABLE))
        for n, option in enumerate(options):
            primary = option.provider is router.primary
            store = self.stores.get(option.space.space_id)
            if store is None:
                errors.append(f"no store for {option.space.space_id}")
                if primary:
                    router.release(option.reservation)
                continue
            at = time.perf_counter()
            try:
                vectors, tokens = [], 0
                for t in texts.values():
                    v, used = option.provider.embed_query_with_usage(t)
                    vectors.append([float(x) for x in v])
                    tokens += used
            except Exception as e:  # noqa: BLE001 - any failure of a provider is one
                errors.append(f"{option.space.provider} failed: {e}")
                if primary:
                    router.record_failure(option.reservation)
                continue
            charge = router.record_usage(tokens, reservation=option.reservation) if primary else None
            timings["embed"] = (time.perf_counter() - at) * 1000
            at = time.perf_counter()
            try:
                rows = store.rows().filter(compile_filter(where, {}, F.parse_json("metadata"))).select("id", "unit")
                q = store.spark.createDataFrame(list(zip(texts, vectors)), "query_id string, vector array<double>")
                q = q.select("query_id", V.unit(F.col("vector")).alias("_q"))
                scored = rows.crossJoin(F.broadcast(q)).select("query_id", "id", V.clip(V.dot(F.col("unit"), F.col("_q"))).alias("score"))
                # dense_k rows a query are kept, and here: a store that fails must fail while there is a fallback
                best = top(scored, self.config.dense_k).persist()
                timings["dense_candidates"] = best.count()
            except Exception as e:  # noqa: BLE001 - as above
                errors.append(f"dense search in {option.space.space_id} failed: {type(e).__name__}")
                continue
            timings["dense_search"] = (time.perf_counter() - at) * 1000
            usd = float(charge.usd) if charge is not None and charge.usd is not None else None
            return best, option, option.is_fallback or n > 0, (tokens, usd)
        return None, options[-1], False, None


def build(catalog, stores=None, router=None, observer=None, **config) -> Retriever:
    """A retriever from its parts, refused early if they don't fit. Without a router there is no dense search."""
    if router is None and stores:
        config.setdefault("dense", False)
    return Retriever(catalog, stores, router, observer, Config(**config))


__all__ = ["Config", "Result", "Retriever", "build", "fuse"]
