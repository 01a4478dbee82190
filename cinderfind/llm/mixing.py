"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a share of all words by weight, capped at max_repeats times what it has; the excess is reshared by
weight (water-filling: the least level at which capped sources give way). A document's expected copies are its
source's target over its source's size. Their whole part is taken outright. Of the fractional parts, pairs meet and
one hands mass to the other at random until one of the two is integral (pivotal method), so each keeps its expected
copies and the total hardly varies. Pairs meet in order of size, so that words as well as documents come out near
the target.

Distribution: a source is cut into groups of one size class and at most GROUP documents by hash of the id, however
hot it is; each group leaves one fractional document at most; residuals meet in groups of FAN, level by level, up
to one for each size class. All draws are hashes of the unit, level and seed, and groups depend on counts alone: reruns agree.

At last the classes of a source meet: one document a class, four classes to a doubling of size, so some eighty
documents whatever the corpus. There the nearest in words of DRAWS random roundings is taken. That choice is a bias, and
its bound is this: at most one document a size class of each source has other expected copies than the target gives
it, by less than one copy, and its copies still are its expected ones rounded up or down. All others are unbiased.

Rows that are equal in doc_id, source and text are one unit with a multiplicity, so a hot one is a single row in every
step; of m such rows, m times the fraction is taken whole, and what is left over is one fractional document.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

MAX_REPEATS = 3
GROUP = 50_000
FAN = 256
DRAWS = 256
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with weight 1, 2, 3, 1, ... by code point, null last, and the water-filled target.

    Window functions over one row a source: what grows with the documents has been summed before.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    full = F.coalesce(F.sum("cap").over(upto), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    # the level if every source before this one is at its cap: the first source whose own cap is not below it ends it
    levelled = ranked.withColumn("level", (total - full) / open_weight)
    ends = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    level = F.coalesce(ends["level"], F.lit(float("inf")))
    return levelled.withColumn("level", level).withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level", "cap")


def _draw(*parts) -> Column:
    """Uniform in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _pivot(p: np.ndarray, u: np.ndarray) -> int:
    """Pairs meet in order; p becomes 0 or 1 in place for all but the last one standing, whose index is returned."""
    stand = 0
    for i in range(1, len(p)):
        a, b = p[stand], p[i]
        if a + b < 1:
            if u[i] * (a + b) < a:
                p[stand], p[i] = a + b, 0.0
            else:
                p[stand], p[i] = 0.0, a + b
                stand = i
        elif u[i] * (2 - a - b) < 1 - b:
            p[stand], p[i] = 1.0, a + b - 1
            stand = i
        else:
            p[stand], p[i] = a + b - 1, 1.0
    return stand


def _meet(group: pa.Table) -> pa.Table:
    """Pivotal rounding of one group in order of size."""
    group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
    p = group["p"].to_numpy().copy()
    stand = _pivot(p, group["u"].to_numpy())
    stands = np.zeros(len(p), bool)
    stands[stand] = True
    return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p)).append_column("stands", pa.array(stands))


def _settle(group: pa.Table) -> pa.Table:
    """The last level of a source, one document a size class: of DRAWS pivotal roundings the one nearest in words."""
    group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
    start, size, want = group["p"].to_numpy(), group["size"].to_numpy(), group["want"].to_numpy()[0]
    rng = np.random.Generator(np.random.Philox(int(group["u"].to_numpy()[0] * (1 << 53))))
    best = None
    for _ in range(DRAWS):
        p, u = start.copy(), rng.random(len(start) + 1)
        stand = _pivot(p, u)
        p[stand] = float(u[-1] < p[stand])
        off = abs(float((p * size).sum()) - want)
        if best is None or off < best[0]:
            best = off, p
    return group.select(list(_OWN)).append_column("p", pa.array(best[1]))


_UNIT = "doc_id long, source string, text_hash long, size long, m long, base long, klass int, block long, p double"
_OWN = ("doc_id", "source", "text_hash", "size", "m", "base")


def _units(docs: DataFrame, ws: Workspace, max_repeats: int, seed: int) -> DataFrame:
    """(doc_id, source, text_hash, size, m, copies, source_size, target): the m rows that are equal in the first three
    are one unit, and copies is what the mix takes of them together."""
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"))
    units = ws.save(units.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("m")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))  # a source without words has no copies
    sources = ws.save(source_targets(sources, max_repeats).withColumn("copies", share), "sources")
    n_max = sources.agg(F.max("n_units")).first()[0] or 0
    known = units.join(sources.select(F.col("source").alias("s"), "copies", "n_units"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    mass = F.when(F.col("size") > 0, F.col("m") * (F.col("copies") - F.floor("copies"))).otherwise(F.lit(0.0))
    base = F.when(F.col("size") > 0, F.col("m") * F.floor("copies")).otherwise(F.lit(0))
    known = known.withColumns({"mass": mass, "base": base, "klass": F.floor(F.log2(F.col("size") + 1) * 4).cast("int"), "blocks": F.ceil(F.col("n_units") / GROUP)})
    known = known.withColumns({"base": (F.col("base") + F.floor("mass")).cast("long"), "p": F.col("mass") - F.floor("mass"), "block": F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("blocks"))})
    names = [x.split()[0] for x in _UNIT.split(", ")]
    live = known.filter("p > 0").select(*names)
    settled = [known.filter("p = 0").select(*_OWN, "p")]
    # levels: blocks of a class meet FAN to one until one is left
    blocks, level = max(1, math.ceil(n_max / GROUP)), 0
    while level == 0 or blocks > 1:
        if level:
            blocks = math.ceil(blocks / FAN)
            live = live.withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        met = live.withColumn("u", _draw("doc_id", "source", "text_hash", F.lit(seed), F.lit(level))).groupBy("source", "klass", "block").applyInArrow(_meet, _UNIT + ", u double, stands boolean")
        met = ws.save(met.drop("u"), f"level-{level}")
        settled.append(met.filter("not stands").select(*_OWN, "p"))
        live = met.filter("stands").drop("stands")
        level += 1
    # then all classes of a source: what they should add is its target less what has been settled
    done = [x.select("source", (F.col("base") + F.col("p")).alias("copies"), "size") for x in settled] + [live.select("source", F.col("base").cast("double").alias("copies"), "size")]
    so_far = reduce(DataFrame.unionByName, done).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
    want = so_far.join(sources.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).select("s", (F.col("target") - F.col("words")).alias("want"))
    live = live.join(want, live["source"].eqNullSafe(want["s"])).drop("s").withColumn("u", _draw("source", F.lit(seed), F.lit(-1)))
    last = ws.save(live.groupBy("source").applyInArrow(_settle, ", ".join(x for x in _UNIT.split(", ") if x.split()[0] in (*_OWN, "p"))), "last")
    out = reduce(DataFrame.unionByName, settled, last.select(*_OWN, "p"))
    out = out.select("doc_id", "source", "text_hash", "size", "m", (F.col("base") + F.round("p").cast("long")).alias("copies"))
    return out.join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _times(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered from 0; in two steps, so that no array grows with n."""
    step = 1 << 16
    many = rows.filter(F.col(n) > 0).withColumn("_cf_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long"))))
    return many.withColumn(name, F.explode(F.sequence("_cf_at", F.least(F.col("_cf_at") + step, F.col(n)) - 1))).drop("_cf_at")


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs(doc_id, source, text).

    Null texts have size 0; null doc_ids and sources are values like others; rows without words get no copies, and a
    source of such rows alone has target 0; an empty table gives an empty result; other columns are left out.
    """
    each = _times(_units(docs, Workspace(docs.sparkSession, "mixing"), max_repeats, seed), "m", "nth")
    copies = F.floor(F.col("copies") / F.col("m")) + (F.col("nth") < F.col("copies") % F.col("m")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def repeat_mixed(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """The documents, each as often as the mix takes it; one that it doesn't take is left out. All columns are kept;
    of rows that are equal in doc_id, source and text, one (any) stands for all."""
    taken = _units(docs, Workspace(docs.sparkSession, "mixing"), max_repeats, seed).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_cf_id"), F.col("source").alias("_cf_source"), F.col("text_hash").alias("_cf_text"), F.col("m").alias("_cf_m"), F.col("copies").alias("_cf_copies"))
    keyed = docs.withColumn("_cf_hash", F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(taken["_cf_id"]) & keyed["source"].eqNullSafe(taken["_cf_source"]) & (keyed["_cf_hash"] == taken["_cf_text"])
    out = keyed.join(taken, same)
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_cf_row"), "_cf_copies"]
    single = out.filter("_cf_m = 1").select(*rows)
    shared = out.filter("_cf_m > 1").groupBy("_cf_id", "_cf_source", "_cf_text").agg(F.first(rows[0]).alias("_cf_row"), F.first("_cf_copies").alias("_cf_copies")).select("_cf_row", "_cf_copies")
    return _times(single.unionByName(shared), "_cf_copies", "_cf_nth").select("_cf_row.*")


def op7_mix_sources(spark, sf_dir):
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
