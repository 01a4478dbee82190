"""Observers of retrieval: called with each result's provenance, never in its way."""

from __future__ import annotations

import time
from typing import Protocol


class Observer(Protocol):
    def on_retrieval(self, result) -> None: ...


def notify(observer: Observer | None, result) -> None:
    if observer is not None:
        try:
            observer.on_retrieval(result)
        except Exception:  # noqa: BLE001 - watching doesn't fail a request
            pass


class LogObserver:
    """Keeps provenance rows, without texts, for a retrieval_log table."""

    def __init__(self):
        self.rows: list[dict] = []

    def on_retrieval(self, result) -> None:
        self.rows.append(result.provenance())

    def frame(self, spark):
        import json

        return spark.createDataFrame([(json.dumps(r, default=str),) for r in self.rows], "provenance string")


class OTelObserver:
    """Spans by OpenTelemetry, if it is there: a root "retrieve" over the whole request, and a child for each phase that
    ran, laid out one behind the other by their measured times. Attributes hold counts, names and times alone."""

    def __init__(self, tracer=None, attributes: dict | None = None, now=time.time_ns):
        if tracer is None:
            from opentelemetry import trace

            tracer = trace.get_tracer("cinderfind")
        self.tracer, self.attributes, self.now = tracer, attributes or {}, now

    def on_retrieval(self, result) -> None:
        end = self.now()
        ms = result.timings
        start = at = max(0, end - int(ms.get("total", 0) * 1e6))
        phases = [
            (f"embeddings {result.model}", "embed", {"gen_ai.operation.name": "embeddings", "gen_ai.request.model": result.model, "gen_ai.usage.input_tokens": result.input_tokens}),
            (f"dense.search {result.dense_backend}", "dense_search", {"retrieval.backend": result.dense_backend, "retrieval.top_k": result.dense_k, "retrieval.result.count": ms.get("dense_candidates")}),
            (f"lexical.search {result.lexical_backend}", "lexical_search", {"retrieval.backend": result.lexical_backend, "retrieval.top_k": result.lexical_k}),
            (f"fuse {result.fusion}", "fusion", {"retrieval.fusion.method": result.fusion}),
        ]
        with self.tracer.start_as_current_span("retrieve", attributes=self.attributes | _facts(result), start_time=start, end_on_exit=False) as root:
            self._children(phases, ms, at, end)
            self._events(root, result)
            root.end(end_time=end)

    def _children(self, phases, ms, at, end) -> None:
        for name, phase, facts in phases:
            if phase in ms:
                span = self.tracer.start_span(name, attributes=_known(facts), start_time=at)
                at = min(end, at + int(ms[phase] * 1e6))
                span.end(end_time=at)

    def _events(self, root, result) -> None:
        for name, when, facts in (
            ("retrieval.fallback", result.fallback_occurred, {"retrieval.provider.selected": result.provider, "retrieval.provider.reason": result.provider_reason}),
            ("retrieval.degraded", result.degraded, {"retrieval.error.count": len(result.errors)}),
            ("budget.threshold_crossed", str(result.provider_reason).startswith("budget_"), {"retrieval.provider.reason": result.provider_reason}),
        ):
            if when:
                root.add_event(name, _known(facts))


def _known(facts: dict) -> dict:
    return {k: v for k, v in facts.items() if v is not None}


def _facts(r) -> dict:
    named = {
        "query_id": r.request_id, "queries.count": r.n_queries, "filters.count": r.filters, "scope.tenant": r.scope_tenant, "fallback": r.fallback_occurred, "degraded": r.degraded,
        "dense.top_k": r.dense_k, "lexical.top_k": r.lexical_k, "final.top_k": r.k, "fusion.method": r.fusion, "latency_ms": r.timings.get("total"), "error.count": len(r.errors),
        "provider.selected": r.provider, "provider.model": r.model, "provider.space_id": r.space_id, "provider.reason": r.provider_reason,
        "dense.backend": r.dense_backend, "lexical.backend": r.lexical_backend, "embedding.estimated_usd": r.estimated_usd,
    }
    out = {f"retrieval.{k}": v for k, v in _known(named).items()}
    return out | ({"error.type": "retrieval.degraded" if r.degraded else "retrieval.recovered"} if r.errors else {})
