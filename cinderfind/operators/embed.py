"""Embedding providers and their use over DataFrames: one call a slice of an Arrow batch, one client a worker."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfind.functions.text import tokens
from cinderfind.functions.vectors import bucket
from cinderfind.model import Space

BATCH = 100
_RUN = re.compile("[0-9a-z]+").findall


class Provider(ABC):
    """Texts to vectors of one space. embed_query may treat queries otherwise than texts."""

    space: Space

    @abstractmethod
    def embed_texts(self, texts):
        """A vector for each text."""

    def embed_query(self, text):
        return self.embed_texts([text])[0]

    def estimate_tokens(self, texts):
        """A quarter of a text's characters, rounded up."""
        return sum(max(1, -(-len(t) // 4)) for t in texts if t)

    def embed_texts_with_usage(self, texts):
        return self.embed_texts(texts), self.estimate_tokens(texts)

    def embed_query_with_usage(self, text):
        return self.embed_query(text), self.estimate_tokens([text])


class HashProvider(Provider):
    """Deterministic bag of words: counts of letter-digit runs by an 8-byte BLAKE2 bucket."""

    def __init__(self, dimension=64, provider: str = "hash", model: str = "bow", version: str = "1"):
        self.space = Space(provider, model, dimension, version)

    def embed_texts(self, texts):
        out = []
        for text in texts:
            v = [0.0] * self.space.dimension
            for run in map(str.encode, _RUN(text.lower())):
                digest = hashlib.blake2b(run, digest_size=8)
                v[int(digest.hexdigest(), 16) % len(v)] += 1.0
            out.append(v)
        return out


MAX_INPUTS, MAX_INPUT_TOKENS, MAX_REQUEST_TOKENS = 2048, 8192, 300_000


def requests(sizes: list[int], batch_size: int = 128, max_tokens: int = MAX_REQUEST_TOKENS, max_input: int = MAX_INPUT_TOKENS) -> Iterator[range]:
    """Runs of inputs that fit one request: at most batch_size inputs and max_tokens tokens."""
    start = total = 0
    for i, n in enumerate(sizes):
        if n > max_input:
            raise ValueError(f"input {i} has {n} tokens; a request takes {max_input} of one input")
        if i > start and (i - start == min(batch_size, MAX_INPUTS) or total + n > max_tokens):
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


class OpenAIProvider(Provider):
    """A client of the OpenAI embeddings API, made by client() (the package is needed only without one)."""

    DIMENSIONS = {f"text-embedding-{name}": n for name, n in zip(("ada-002", "3-large", "3-small"), (1536, 3072, 1536))}

    def __init__(self, model="text-embedding-3-small", client: Callable | None = None, batch_size: int = 128, version: str = "1"):
        self.space = Space("openai", model, self.DIMENSIONS[model], version)
        if not 1 <= batch_size <= MAX_INPUTS:
            raise ValueError(f"a request takes 1 to {MAX_INPUTS} inputs")
        self.batch_size, self._make, self._client = batch_size, client, None

    @property
    def client(self):
        if self._client is None:
            if self._make is None:
                import openai

                self._make = openai.OpenAI
            self._client = self._make()
        return self._client

    def embed_texts_with_usage(self, texts):
        if any(not t for t in texts):
            raise ValueError("an empty text can't be embedded")
        out, used = [], 0
        for run in requests([self.estimate_tokens([t]) for t in texts], self.batch_size):
            answer = self.client.embeddings.create(model=self.space.model, input=[texts[i] for i in run])
            out += [list(d.embedding) for d in sorted(answer.data, key=lambda d: d.index)]
            used += answer.usage.total_tokens
        return out, used

    def embed_texts(self, texts):
        return self.embed_texts_with_usage(texts)[0]


class SentenceTransformerProvider(Provider):
    """A local model, loaded where it is first used; unit vectors."""

    DIMENSIONS = {"all-mpnet-base-v2": 768} | {f"all-MiniLM-L{n}-v2": 384 for n in (6, 12)}

    def __init__(self, model="all-MiniLM-L6-v2", dimension=None, load: Callable | None = None, batch_size: int = 32, version: str = "1"):
        self._load, self._loaded, self.batch_size, self._name = load, None, batch_size, model
        self.space = Space("sentence-transformers", model, dimension or self.DIMENSIONS.get(model) or self.model.get_sentence_embedding_dimension(), version)

    @property
    def model(self):
        if self._loaded is None:
            if self._load is None:
                from sentence_transformers import SentenceTransformer

                self._load = SentenceTransformer
            self._loaded = self._load(self._name)
        return self._loaded

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed_texts(self, texts):
        return [list(map(float, v)) for v in self.model.encode(texts, batch_size=self.batch_size, normalize_embeddings=True)]


def hashed(rows: DataFrame, dimension: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding): hashed bags of words as functions.vectors.hash_embed makes them, by one aggregation over
    (key, bucket); a text without words is a zero vector."""
    parts = rows.select(key, F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    counts = parts.select(key, bucket(F.col("_t"), dimension).alias("_b")).groupBy(key, "_b").agg(F.count("_b").cast("double").alias("_n"))
    bag = counts.groupBy(key).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("_b", "_n")), lambda x: x["_b"].isNotNull())).alias("_m"))
    return bag.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long")), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("embedding"))


def checked(provider: Provider, texts: list) -> list:
    vectors = provider.embed_texts(texts)
    if len(vectors) != len(texts):
        raise ValueError(f"{len(texts)} texts came back as {len(vectors)} vectors")
    if any(len(v) != provider.space.dimension for v in vectors):
        raise ValueError("a vector isn't of its space's dimension")
    return vectors


def embed(rows: DataFrame, provider: Provider, text: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with vector (array<float>), embedded batch texts at a time."""
    fields = rows.schema

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = checked(provider, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(v, pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*fields.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
