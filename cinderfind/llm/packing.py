"""Best-fit packing of tokenized documents into sequences.

Best-fit decreasing over all pieces at once. Piece lengths are integers up to the sequence length, so what the greedy
does depends on how many pieces of each length there are: the driver runs it on that histogram (at most max_len
numbers, whatever the corpus), places runs of equal pieces into runs of equal bins, and finds the tightest open bin
with a segment tree over remaining capacities. The result is the bin each piece gets in the document-by-document
greedy, up to the order of equal pieces. Executors then look their pieces' places up by (length, rank).

Skew: a length that a third of all pieces share is one run in the plan; ranks are counted where the pieces are made.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

MAX_LEN = 2048
CACHE = 600_000  # words that a worker process remembers


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in prints else next(rest)) for b in range(256)}


class Ids(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, remembered for up to CACHE words.

    Most texts are of letters below U+0180, in composed form. Those are lower-cased and parted into words here, as
    the tokenizer's own normalizer and pre-tokenizer do it, and only new words meet its model. Any other text, and
    one that may hold a special token's string, goes to the tokenizer whole.
    """

    _letters, _digits = ("".join(re.escape(chr(i)) for i in range(0x180) if unicodedata.category(chr(i))[0] == kind) for kind in "LN")
    part = re.compile(rf"[{_letters}]+|'(?:s|t|re|ve|m|ll|d)|[{_digits}]|[^\s{_letters}{_digits}]+").findall
    foreign = re.compile(r"[^\x00-\x1b\x20-\u012f\u0131-\u017e]|<\|").search
    letters = _byte_letters()

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        got = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def ids(self, text: str) -> bytes:
        if self.foreign(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, self.part(text.lower())))


@lru_cache(1)
def _ids(tokenizer_path: str) -> Ids:
    """One for a worker process: what it has learned serves its later tasks."""
    from tokenizers import Tokenizer

    return Ids(Tokenizer.from_file(tokenizer_path))


def _pieces(tokenizer_path: str, max_len: int):
    def run(it):
        words = _ids(tokenizer_path)
        task, ranks, width = TaskContext.get().partitionId(), {}, 4 * max_len
        for batch in it:
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    doc.append(doc_id), piece.append(k), start.append(at // 4), length.append(n), crc.append(zlib.crc32(part))
                    rank.append(r := ranks.get(n, 0))
                    ranks[n] = r + 1
            columns = (doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([task] * len(doc), pa.int32()), (rank, pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


class Tightest:
    """Segment tree over remaining capacities 0..top: the least one of at least n that has open bins."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def push(self, room: int, run: tuple[int, int]) -> None:
        if run[1] <= 0:
            return
        if not self.bins[room]:
            i = room + self.size
            while i and not self.tree[i]:
                self.tree[i] = 1
                i >>= 1
        self.bins[room].append(run)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.bins[room].pop()
        if not self.bins[room]:
            i = room + self.size
            self.tree[i] = 0
            while i > 1 and not (self.tree[i] | self.tree[i ^ 1]):
                i >>= 1
                self.tree[i] = 0
        return run

    def find(self, n: int) -> int:
        i = n + self.size
        if self.tree[i]:
            return n
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts[length]: runs (length, first rank, first bin, pieces a bin, offset in the bin)."""
    tree, runs, next_bin = Tightest(max_len), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            room = tree.find(length)
            if room < 0:
                room, bins = max_len, (next_bin, -(-left // (max_len // length)))
                next_bin += bins[1]
            else:
                bins = tree.pop(room)
            per = room // length
            put = min(left, bins[1] * per)
            full, part = divmod(put, per)
            runs.append((length, rank, bins[0], per, max_len - room))
            tree.push(room - per * length, (bins[0], full))
            if part:
                tree.push(room - part * length, (bins[0] + full, 1))
            used = full + (part > 0)
            tree.push(room, (bins[0] + used, bins[1] - used))
            left, rank = left - put, rank + put
    return runs


def _place(runs):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shift = np.int64(1) << 44
    keys = table[:, 0] * shift + table[:, 1]

    def run(it):
        for batch in it:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "at"))
            at = table[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - at[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces of every (doc_id, text) and their places in sequences of at most max_len tokens.

    A document is its ids, then id 0; only one longer than max_len is cut. Null and empty texts are the one id 0.
    Rows that repeat a doc_id are packed as rows of their own; an empty table gives an empty result; other columns
    are left out. Broadcast to tasks: the plan, whose size depends on max_len alone.
    """
    ws = Workspace(docs.sparkSession, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    made = ws.save(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, max_len), schema), "pieces")
    here = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = here.select("task", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    placed = made.join(before.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("at"))
    return placed.mapInArrow(_place(plan(counts, max_len)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
