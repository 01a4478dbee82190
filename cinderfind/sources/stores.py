"""Vector stores: one table, partitioned by embedding space; unit vectors are kept, so that search is one product."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfind.functions import vectors as V
from cinderfind.model import VECTORS
from cinderfind.plans.filters import compile_filter
from cinderfind.sources.tables import Table, staged, upserted

_FACTORIES: dict = {}


def register_store(name: str, factory) -> None:
    if not (name and isinstance(name, str)):
        raise ValueError("a store has a name")
    _FACTORIES[name] = factory


def create_store(name: str, **options):
    if name not in _FACTORIES:
        raise ValueError(f"no store is called {name!r}; there are {sorted(_FACTORIES)}")
    return _FACTORIES[name](**options)


class VectorStore:
    """Chunks (id, text, metadata as JSON text) with vectors of one space."""

    def __init__(self, spark: SparkSession, path: str, space_id: str, dimension: int):
        self.spark, self.space_id, self.dimension = spark, space_id, dimension
        self.table = Table(spark, path, VECTORS, ["space_id", "id"], ["space_id"])

    def rows(self) -> DataFrame:
        return self.table.read().filter(F.col("space_id") == self.space_id)

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """rows (id, text, metadata, vector): inserts, or replaces all of a row of equal id; metadata isn't merged."""
        unit = V.unit(V.checked(F.col("vector"), self.dimension)).cast("array<float>")
        new = rows.select("id", "text", "metadata", unit.alias("unit"), F.lit(self.space_id).alias("space_id"), *([order] if order else []))
        self.table.commit(upserted(self.table.read(), new, ["space_id", "id"], order))

    def prepared(self, rows: DataFrame) -> str:
        """The name of a version of rows, as upsert() takes them and of ids that are unique, which adopt() puts in place."""
        unit = V.unit(F.col("vector")).cast("array<float>")
        return self.table.prepared(rows.select("id", "text", "metadata", unit.alias("unit"), F.lit(self.space_id).alias("space_id")))[0]

    def adopt(self, name: str, ids: DataFrame) -> None:
        """Upserts the rows of a prepared version, whose ids are these."""
        made = self.spark.read.schema(VECTORS).parquet(f"{self.table.path}/{name}")
        made.select(F.sum(F.size(V.checked(F.col("unit"), self.dimension)))).collect()  # an error for one that isn't sound
        old = self.table.read()
        gone = ids.select("id", F.lit(self.space_id).alias("space_id"))
        keys = staged(self.spark, self.table.path, old.select("space_id", "id").join(gone, ["space_id", "id"], "left_anti"))
        self.table.adopt(name, None if keys.isEmpty() else old.join(gone, ["space_id", "id"], "left_anti"))

    def delete(self, ids: DataFrame) -> None:
        gone = ids.select("id", F.lit(self.space_id).alias("space_id")).distinct()
        self.table.commit(self.table.read().join(gone, ["space_id", "id"], "left_anti"))

    def search(self, query: list[float], k: int = 5, where: dict | None = None, columns: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
        """(id, text, metadata, score), best first. where filters metadata before the k are chosen."""
        if len(query) != self.dimension:
            raise ValueError(f"a query of this space has {self.dimension} components")
        rows = self.rows()
        if where:
            rows = rows.filter(compile_filter(where, columns or {}, F.parse_json("metadata")))
        else:
            compile_filter(where, {}, F.lit(None))
        if k < 1:
            return rows.select("id", "text", "metadata", F.lit(0.0).alias("score")).limit(0)
        n = sum(float(x) ** 2 for x in query) ** 0.5
        q = F.array(*[F.lit(float(x) / n if n else 0.0) for x in query])
        return rows.select("id", "text", "metadata", V.clip(V.dot(F.col("unit"), q)).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def get(self, ids: list[str]) -> DataFrame:
        """In the order asked for; unknown ids are skipped, repeated ones repeated."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return self.rows().join(F.broadcast(wanted), "id").orderBy("pos").select("id", "text", "metadata")

    def count(self) -> int:
        return self.rows().count()

    def validate(self) -> DataFrame:
        """One row of what a sound store has 0 of: wrong or non-finite vectors, repeated or missing ids."""
        bad = F.count_if(~V.sound(F.col("unit"), self.dimension)).alias("bad_vectors")
        return self.rows().agg(bad, (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("missing_ids"))

    def save(self, path: str) -> None:
        self.rows().write.mode("overwrite").parquet(f"{path}/vectors")
        self.spark.createDataFrame([(json.dumps({"format": 1, "space_id": self.space_id, "dimension": self.dimension}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, into: str) -> "VectorStore":
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest.get("format") != 1:
            raise ValueError(f"{path} has a format that isn't known")
        store = cls(spark, into, manifest["space_id"], manifest["dimension"])
        store.table.commit(upserted(store.table.read(), spark.read.schema(VECTORS).parquet(f"{path}/vectors"), ["space_id", "id"]))
        found = store.validate().first()
        if any(found):
            raise ValueError(f"{path} isn't sound: {found.asDict()}")
        return store


register_store("table", VectorStore)


class VectorIndex:
    """A provider and a store of its space: search by text."""

    def __init__(self, provider, store: VectorStore):
        if provider.space.space_id != store.space_id or provider.space.dimension != store.dimension:
            raise ValueError("provider and store are of different spaces")
        self.provider, self.store = provider, store

    def upsert(self, rows: DataFrame) -> None:
        from cinderfind.operators.embed import embed

        self.store.upsert(embed(rows.select("id", "text", "metadata"), self.provider))

    def search(self, text: str, k: int = 5, where: dict | None = None) -> DataFrame:
        query = self.provider.embed_query(text) if k > 0 else [0.0] * self.store.dimension
        return self.store.search(query, k, where)
