"""Snapshot tables: Parquet versions behind a pointer file, for upserts and deletes without MERGE.

A commit writes a new version beside the old one and then moves the pointer, so a reader sees one version or the
other, and a failed job leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], partition_by: list[str] | None = None):
        self.spark, self.path, self.schema, self.keys, self.partition_by = spark, path.rstrip("/"), schema, keys, partition_by or []

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        return self.text(f"{self.path}/_CURRENT")

    def text(self, path: str) -> str | None:
        """What a small file holds."""
        fs, pointer = self._fs(path)
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The current version; an empty table before the first commit."""
        at = self.version()
        if at is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}")

    def commit(self, rows: DataFrame) -> str:
        """Makes rows the table. They may be derived from the version before."""
        name = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return self._point(name)

    def _point(self, name: str) -> str:
        fs, fresh = self._fs(f"{self.path}/_NEXT-{name}")
        out = fs.create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        _, pointer = self._fs(f"{self.path}/_CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(fresh), context.makeQualified(pointer), over)
        self.spark.catalog.refreshByPath(self.path)
        return name

    def prepared(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """(name, rows) of a version that no reader sees before adopt(): rows are made and written once."""
        name = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def adopt(self, name: str, rest: DataFrame | None = None) -> str:
        """Makes a prepared version the table, with the rows of rest beside its own."""
        if rest is not None:
            rest.select(*self.schema.names).write.mode("append").partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return self._point(name)

    def discard(self, name: str) -> None:
        """Drops a prepared version."""
        fs, at = self._fs(f"{self.path}/{name}")
        fs.delete(at, True)

    def vacuum(self) -> None:
        """Drops every version but the current one, and what was staged."""
        fs, root = self._fs(self.path)
        current = self.version()
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v-") and name != current or name == "_staged":
                fs.delete(status.getPath(), True)

    def upsert(self, rows: DataFrame, order: str | None = None, unique: bool = False) -> None:
        """Inserts rows or replaces those of equal keys. Of rows with equal keys the last by order wins. unique: there
        are none, so rows aren't sorted by their keys."""
        if unique:
            self.commit(self.read().join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows))
        else:
            self.commit(upserted(self.read(), rows, self.keys, order))

    def delete(self, ids: DataFrame) -> None:
        """Drops rows whose keys are in ids; unknown ones do nothing."""
        self.commit(self.read().join(ids.select(*ids.columns).distinct(), ids.columns, "left_anti"))


def staged(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows as a table of their own below a path: made once, however often they are read, and not gathered anywhere.
    It stays until Table.vacuum() of that path."""
    at = f"{path.rstrip('/')}/_staged/{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def last_wins(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by order, or without one the last to arrive (by partition, and there by place)."""
    if order is None:
        rows, order = rows.withColumn("_arrived", F.monotonically_increasing_id()), "_arrived"
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", order)


def upserted(old: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    new = last_wins(rows, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
