"""Shared plumbing: tables in the cluster's shared folder, and connected components over edges."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIVE: list["Workspace"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="cinderfind-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Workspace:
    """Tables that cut lineage: a lost executor costs its running tasks, never an earlier step.

    They live in the shared folder until drop(), sweep() or the end of the process, since a returned
    DataFrame reads them lazily.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _LIVE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def sweep(tag: str | None = None) -> None:
    """Drops every table of workspaces so tagged (all by default). Call it once what reads them is written."""
    for ws in [w for w in _LIVE if tag in (None, w.tag)]:
        _LIVE.remove(ws)
        try:
            ws.drop()
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


atexit.register(sweep)


@contextmanager
def swept():
    """Drops, at its end, the tables of the workspaces that were made within: what read them has been written by then."""
    before = set(map(id, _LIVE))
    yield
    for ws in [w for w in _LIVE if id(w) not in before]:
        _LIVE.remove(ws)
        ws.drop()


def _union_find(it):
    """Edges of one partition -> (node, root) of its forest: as many edges as nodes at most."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(x) for x in parent), np.int64, len(parent))
    keep = nodes != roots
    yield pa.record_batch([pa.array(nodes[keep]), pa.array(roots[keep])], names=["node", "root"])


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the least id of each node's component, for nodes of undirected edges (a, b), but roots themselves.

    Alternates local forests with a min-label star step (large star / small star); each round is a table. No
    component is gathered in one task: a hub's edges meet in an aggregation that combines map-side.
    """
    spark = ws.spark
    forest = lambda e: e.mapInArrow(_union_find, "node long, root long")
    cur = ws.save(forest(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), f"{name}-0")
    step = 0
    while True:
        step += 1
        # each node with several parents: link them to the least one; a forest has one parent per node
        least = cur.groupBy("node").agg(F.min("root").alias("low"), F.count_distinct("root").alias("n"))
        up = least.select(F.col("node").alias("root"), F.col("low").alias("top"))
        linked = (
            cur.join(least.filter("n > 1").select("node", "low"), "node")
            .filter("root <> low")
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
        )
        jumped = least.select("node", F.col("low").alias("root")).join(up, "root", "left")
        nxt = jumped.select("node", F.coalesce("top", "root").alias("root")).unionByName(linked).distinct()
        nxt = ws.save(nxt, f"{name}-{step}")
        done = nxt.join(nxt.select(F.col("node").alias("root")), "root", "left_semi").isEmpty() and (
            nxt.groupBy("node").count().filter("count > 1").isEmpty()
        )
        ws.drop(f"{name}-{step - 1}")
        if done:
            return nxt
        cur = nxt
