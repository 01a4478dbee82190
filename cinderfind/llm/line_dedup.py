"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Each document is a sequence of line IDs. Round k ranks the suffixes by their first 2^k lines: the rank of a pair (own
rank, rank 2^k lines on) among the sorted distinct pairs, which a range-partitioned sort spreads over all tasks. A
suffix whose rank is its own is settled and leaves, so rounds shrink quickly; they end when none is left. Suffixes of
one rank after round k are the LCP interval of depth 2^k, and its least member is the earliest occurrence of that run
of lines. Every other member's 2^k lines are a later copy. A maximal repeated run of n lines, 2^k <= n < 2^(k+1), is
the union of its first and its last 2^k lines, both of which the intervals of round k hold; so the union of the later
members over all rounds is just what maximal runs cover, and it is deleted.

Runs of MIN_LINES lines at least count (that is, rounds from log2 MIN_LINES on, and MIN_LINES is a power of two), or
single lines of MIN_WORDS words at least: only a line of one word, such as a bullet or a bracket, may stand alone again.

A hot line, or a hot pair of lines, is one row after map-side combination; where ranks are joined back to suffixes, the
hot side is streamed against single rows, and adaptive execution splits it.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

MIN_LINES = 2
MIN_WORDS = 2


def line_id(line: Column) -> Column:
    """128 bits of a line without its outer white space."""
    return F.unhex(F.md5(F.trim(line)))


def _place(hash_: Column) -> Column:
    """A document's place in the order: doc_id; without one, one of the last 2^40 numbers by its text, so that rows
    without an id are as many documents as they have texts, and no one group."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(sys.maxsize) - hash_.bitwiseAND((1 << 40) - 1))


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, spans): for documents with later copies, the merged spans [start, end) of lines to delete.

    Documents rank by doc_id, those without one after all others by their text's hash (doc is then such a place, see
    _place). Rows that share both doc_id and text are one.
    """
    ws = Workspace(docs.sparkSession, "lines")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(_place(F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    # pos counts lines that aren't blank; line is the place among all
    full = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at"))), lambda x: x["line"] != "")
    lines = keyed.select("doc", "hash", F.posexplode(full).alias("pos", "x"))
    lines = lines.select("doc", "hash", "pos", F.col("x.at").alias("line"), line_id(F.col("x.line")).alias("id"), F.size(F.split("x.line", r"\s+")).alias("words"))
    lines = ws.save(lines, "lines")
    shared = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rank = ws.save(shared.orderBy("id").withColumn("rank", F.monotonically_increasing_id()), "rank-0")
    suffix = ["doc", "hash", "pos"]
    active = lines.join(rank, "id").groupBy(*suffix).agg(*[F.first(c).alias(c) for c in ("line", "rank", "words")]).withColumn("last", F.col("line"))
    active = ws.save(active, "active-0")
    ws.drop("lines")
    spans, width, step = [], 1, 0
    while True:
        # the interval's least member by (doc, hash, pos); who else is in it holds a later copy of width lines
        first = active.groupBy("rank").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
        copies = active.join(first, "rank")
        within = Window.partitionBy("rank", "doc").orderBy("hash", "pos")
        own = copies.filter((F.col("doc") == F.col("first")) & (F.col("n") > 1)).withColumn("nth", F.row_number().over(within)).filter("nth > 1")
        late = copies.filter("doc > first").select("doc", "hash", "line", "last", "words").union(own.select("doc", "hash", "line", "last", "words"))
        if width < min_lines:
            late = late.filter(F.col("words") >= min_words) if width == 1 else late.limit(0)
        spans.append(ws.save(late.select("doc", "hash", F.col("line").alias("start"), (F.col("last") + 1).alias("end")), f"spans-{step}"))
        # the next round: pairs (rank, rank width lines on) that at least two suffixes share
        on = active.select("doc", "hash", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"), F.col("last").alias("end"))
        pairs = ws.save(active.join(on, suffix).select(*suffix, "line", F.col("end").alias("last"), "rank", "next", "words"), f"pairs-{step}")
        held = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        ranks = ws.save(held.orderBy("rank", "next").withColumn("new", F.monotonically_increasing_id()), f"rank-{step + 1}")
        further = ws.save(pairs.join(ranks, ["rank", "next"]).select(*suffix, "line", "last", F.col("new").alias("rank"), "words"), f"active-{step + 1}")
        for name in (f"active-{step}", f"rank-{step}", f"pairs-{step}"):
            ws.drop(name)
        active, width, step = further, 2 * width, step + 1
        if active.isEmpty():
            break
    found = spans[0]
    for s in spans[1:]:
        found = found.union(s)
    order = Window.partitionBy("doc", "hash").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc", "hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the later copies of repeated line runs, and removed: their spans [start, end) in lines.

    Every row comes back with all its columns. Null text stays null; a text that loses all its lines is empty. Lines
    are parted at line feeds, and compared without outer blanks; blank lines don't count, and go with a
    run that is deleted around them.
    """
    docs = docs.drop("removed")
    spans = removed_lines(docs, min_lines, min_words)
    hash_ = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.withColumns({"_cf_doc": _place(hash_), "_cf_hash": hash_}).join(spans.withColumnsRenamed({"doc": "_cf_doc", "hash": "_cf_hash", "spans": "removed"}), ["_cf_doc", "_cf_hash"], "left")
    lines = F.split("text", "\n")
    # the kept lines are those between the spans: slices, not a test of each line against each span
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.size("_cf_lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(F.col("_cf_lines"), s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0)))))
    out = joined.withColumn("_cf_lines", lines).withColumn("_cf_kept", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*[F.col("_cf_kept").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce("removed", F.array()).cast("array<struct<start:int,end:int>>").alias("removed"))


def op1_line_dedup(spark, sf_dir):
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", n.alias("removed_lines"), "removed")
