"""Value types of the engine: scopes, embedding spaces, errors and table schemas. Nothing here starts a Spark job."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

DOCUMENT_COLUMNS = tuple("doc_id title source doc_type tenant_id visibility owner_group status created_at updated_at".split())


class EngineError(Exception):
    """Base of the engine's own errors."""


class SourceError(EngineError, ValueError):
    """A source cannot be read as records."""


class LexicalUnavailable(EngineError):
    """The lexical index is missing; dense and structured retrieval still work."""


class NoProvider(EngineError):
    """Routing turned the primary provider down and no fallback stands in. reason: the routing reason."""

    def __init__(self, reason):
        super().__init__(f"no provider can embed: primary turned down ({reason})")
        self.reason = reason


class PricingUnavailable(EngineError):
    """Budgets are set for a model whose price isn't known."""


@dataclass(frozen=True)
class Scope:
    """Who asks: a tenant and a tuple of visibilities. None leaves that side open."""

    tenant_id: "str | None" = None
    visibility: "tuple | None" = None

    def __post_init__(self):
        if self.tenant_id is not None and not (isinstance(self.tenant_id, str) and self.tenant_id.strip()):
            raise ValueError("tenant_id is a non-blank string or None")
        if self.visibility is not None:
            seen = tuple(self.visibility)
            if not seen or not all(isinstance(v, str) and v for v in seen):
                raise ValueError("visibility is a non-empty tuple of non-empty strings or None")
            object.__setattr__(self, "visibility", seen)

    @property
    def open(self) -> bool:
        return self.tenant_id is None and self.visibility is None


def sanitize(part: object) -> str:
    """Lower-case letters and digits joined by single underscores; nothing left is an error."""
    out = "_".join(re.findall("[0-9a-z]+", str(part).lower()))
    if not out:
        raise ValueError(f"{part!r} has no letter or digit")
    return out


@dataclass(frozen=True)
class Space:
    """The identity of an embedding space. Vectors of different spaces are never compared."""

    provider: "str"
    model: "str"
    dimension: "int"
    version: "str" = "1"

    def __post_init__(self):
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension < 1:
            raise ValueError("a space has a positive whole dimension")
        self.space_id  # noqa: B018 - each part must survive

    @property
    def space_id(self) -> str:
        return "__".join(map(sanitize, (self.provider, self.model, self.dimension, self.version)))


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(fields: str) -> T.StructType:
    """From "name type, ..." without a Spark session, since workers import this too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


DOCUMENTS = _schema(", ".join(f"{c} string" for c in (*DOCUMENT_COLUMNS, "attributes")))
CHUNKS = _schema("chunk_id string, doc_id string, text string, chunk_index int, section_path string, content_hash string, active boolean")
EMBEDDED = _schema("chunk_id string, space_id string, provider string, model string, dimension int, version string, content_hash string, created_at timestamp")
VECTORS = _schema("id string, text string, metadata string, unit array<float>, space_id string")
USAGE = _schema(
    "event_id string, date date, provider string, model string, processing_mode string, tokens bigint, rate_nanos_per_million bigint, price_version string, "
    "charge_nanos bigint, status string, expires_at timestamp, created_at timestamp"
)
