"""Substring dedup by hashing of text units: the earliest ranked occurrence stays, later ones go.

Units are lines, normalised: lower-cased and white space collapsed. Whole lines alone would miss a passage that is
pasted into the middle of a line and begins or ends inside a sentence, so the named extension here is the sub-line
unit: a line of more than GAP words is parted at words chosen by winnowing, those whose hash (with the next word's) is
the least of some GAP words in a row. The choice depends on GAP words around alone, so a pasted passage is parted
where its source is, and no unit is longer than GAP words. A digest (64 bits) is that of the units from one on up to
WINDOW words at least, so it never stands for a common word or two. Digests are grouped globally. Units in a window that
an earlier document has, or that came before in the same document, are copies; runs of copies of MIN_WORDS words at
least are cut, and their original offsets kept. Shorter repeats (headings, boilerplate lines) are left alone.

A passage of n words that two documents share, wherever its borders are, holds a run of n - 3 * GAP words of such units
at the very least, and nearly always more: of 3,000 random ones of 50 words, 99.5 % have a run of MIN_WORDS, and all of
60 words do. A few words may stay at either end.

The rank is doc_id; rows without one come last, by their text's hash, each a document of its own. Rows that share a
doc_id rank equally and don't cut one another. A digest's first document comes from an aggregation that combines
map-side, so a hot digest costs one row a task; only digests that several documents share are joined back, and a hot
one is streamed against a single row.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

GAP = 8  # a power of two
WINDOW = 8
MIN_WORDS = 32
CACHE = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Words(dict):
    """word -> its hash, for up to CACHE words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


@lru_cache(1)
def _words() -> _Words:
    return _Words()


@lru_cache(64)
def _powers(bits: int, base: int) -> np.ndarray:
    """base ** i for i below 2 ** bits, modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    for k in range(bits):
        out = np.concatenate([out, out * np.uint64(pow(base, 1 << k, 1 << 64))])
    return out


def _winnowed(code: np.ndarray) -> np.ndarray:
    """Places whose hash, with the next word's, is the least of some GAP in a row; the last of equal ones."""
    n = len(code)
    pair = code.copy()
    pair[:-1] += code[1:] * _P
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mask = (1 << max(1, int(n).bit_length())) - 1
    least = (pair & ~np.uint64(mask)) | (np.uint64(mask) - np.arange(n, dtype=np.uint64))
    step = 1
    while step < GAP and len(least) > step:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = least[np.r_[True, least[1:] != least[:-1]]]  # a place is the least of windows in a row
    return np.unique(mask - (least & np.uint64(mask)).astype(np.int64))


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(begin, end, digest) of each unit's window in words, ascending, and the number of words."""
    lines = [line.split() for line in text.lower().split("\n")]
    words = [w for line in lines for w in line]
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    code = np.fromiter(map(_words().__getitem__, words), np.uint64, n)
    unit = np.zeros(n, bool)
    unit[_winnowed(code)] = True
    starts = np.cumsum([0, *map(len, lines)])[:-1]
    unit[starts[starts < n]] = True
    begin = np.flatnonzero(unit)
    edges = np.append(begin, n)
    end = edges[np.minimum(np.searchsorted(edges, begin + WINDOW), len(begin))]
    bits = int(n).bit_length()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(bits, int(_P))[:n])])
    digest = (total[end] - total[begin]) * _powers(bits, int(_P_INVERSE))[begin]
    digest ^= (end - begin).astype(np.uint64) * _P
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return begin, end, (digest ^ (digest >> np.uint64(29))).view(np.int64), n


def _distinct(it):
    for batch in it:
        ids, found, rows = [], [], 0

        def out():
            return pa.record_batch([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["rank", "digest"])

        for rank, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.unique(windows(text.as_py() or "")[2])
            ids.append(np.full(len(own), rank, np.int64)), found.append(own)
            rows += len(own)
            if rows > 200_000:
                yield out()
                ids, found, rows = [], [], 0
        yield out()


def runs(text: str, later: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Runs of copied words [begin, end), min_words at least. later: digests that an earlier document has."""
    begin, end, digest, n = windows(text)
    _, first = np.unique(digest, return_index=True)
    again = np.ones(len(digest), bool)
    again[first] = False
    copied = again | np.isin(digest, later)
    step = np.zeros(n + 2, np.int64)
    np.add.at(step, begin[copied] + 1, 1)
    np.add.at(step, end[copied] + 1, -1)
    edge = np.diff((np.cumsum(step) > 0).astype(np.int8))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if b - a >= min_words]


def cut(text: str, later: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The spans to remove, in code points of the text: from a run's first word to the word after it."""
    found = runs(text, later, min_words)
    if not found:
        return []
    at = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    return [(at[a] if a else 0, at[b]) for a, b in found]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cutter(min_words: int):
    def run(it):
        for batch in it:
            texts, spans = [], []
            for text, later in zip(batch.column("text"), batch.column("_later")):
                text = text.as_py()
                known = later.values.to_numpy() if later.is_valid else np.zeros(0, np.int64)
                found = cut(text, known, min_words) if text else []
                spans.append([{"start": a, "end": b} for a, b in found])
                for a, b in reversed(found):
                    text = text[:a] + text[b:]
                texts.append(text)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], names=["doc_id", "text", "removed"])

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text): doc_id, text without later copies, removed (spans of the original text in code points).

    Every row comes back, also one that has lost all its text. Null text stays null and loses nothing. Rows without a
    doc_id, equal ones apart, cut one another like any others. Other columns are left out. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "substring")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(sys.maxsize) - F.xxhash64("text").bitwiseAND((1 << 40) - 1))
    ranked = docs.select(rank.alias("_rank"), "doc_id", "text")
    own = ws.save(ranked.select("_rank", "text").mapInArrow(_distinct, "rank long, digest long"), "units")
    first = own.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first < last").drop("last")
    later = own.join(first, "digest").filter("rank > first").groupBy("rank").agg(F.collect_set("digest").alias("_later"))
    joined = ranked.join(later, F.col("_rank") == F.col("rank"), "left").select("doc_id", "text", "_later")
    return joined.mapInArrow(_cutter(min_words), "doc_id long, text string, removed array<struct<start:long,end:long>>")


def op5_substring_dedup(spark, sf_dir):
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), removed.alias("removed_chars"), "removed")
