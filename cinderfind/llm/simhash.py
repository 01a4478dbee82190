"""Near-dedup by SimHash and an LSH forest.

Words are runs of letters and digits in lower case. Documents with equal words are one node. A node's SimHash has BITS
bits over its five-word shingles. Each trie of the forest orders the bits by a permutation of its own; documents that
share a prefix in some trie are candidates, and all candidates are verified by the Jaccard similarity of their shingle sets.

The forest joins the bulk of a class cheaply, and a leaf's depth follows the density around it: a prefix of at most LEAF
documents is a leaf, a denser one goes on by as many further bits of its trie as its count asks for. Within leaves each
document proposes its nearest and one that all share; verified links join classes.

SimHash is a matter of chance, so what it leaves is found exactly, between different classes alone. Two sets at the
threshold differ in d shingles at most (d by their class of size). Each set is parted into more than d + 1 parts by hash;
at most d of these differ, so any two sets share one of the d + 1 fullest (see tokens). Documents that share a part
meet in a bucket, whatever their SimHash. A part holds some four shingles, so a line or passage that many documents have
makes no bucket by itself.

A bucket with more than BUCKET documents is worked off in pairs of blocks, so no task holds one whole and none is
skipped. Each document proposes its nearest WIDTH of other classes; once those are verified and joined, further rounds
propose, wider each time, what still lies between different classes, until nothing is left over. So a class of n costs
some n links, not n * n, and no link between classes goes unverified. What documents that share a part propose must
be near by sizes and sketches already in the bucket, so dissimilar ones are compared there and never become pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace, components

BITS = 128
DEPTH = 11  # bits of the last depth, at least
TRIES = 8  # tries that are built; shape() tells how many a forest without an exact pass would take
CROWD = 8192  # documents to a prefix of the last depth, on average, from which the forest grows deeper
LEAF = 1024
DEEPER = 20  # further bits of a trie below the last depth
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.98
BUCKET = 2048
SHORT = 32  # shingles of a set whose bits are uneven (4 against 5 shingles differ in 3/16 of them)
SMALL = 8  # a bucket of so many is compared in full at once
WIDTH = 4
HASHES = 1 << 20  # of ids: so many are broadcast at most
SIGMAS = 2.9
FOLDED = 1024  # bits of the sketches that are compared in buckets
CHUNK = 1024  # documents of which a task packs the parts at once
PART = 1 << 21  # parts of sets that a task sorts at once
CACHE = 500_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: Column) -> Column:
    """The words of a text, joined by blanks: runs of letters and digits in lower case. A text that has none is taken as
    it is, its white space collapsed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    return F.when(words != "", words).otherwise(F.trim(F.regexp_replace(low, r"\s+", " ")))


def shingles(words: str) -> np.ndarray:
    """Distinct 64-bit hashes of five-word shingles of a normal text; a shorter one, also an empty one, is one shingle."""
    words = words.split()
    codes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - SHINGLE + 1)
    total = np.full(n, len(codes) if len(codes) < SHINGLE else 0, np.uint64)
    for j in range(min(SHINGLE, len(codes))):
        total += _mix(codes[j : j + n] * _C[j])
    return np.unique(_mix(total))


def simhash(found: np.ndarray) -> np.ndarray:
    """BITS bits (0 or 1) of a set of hashes."""
    n = len(found)
    wide = np.zeros((-(-n // 255) * 255, 2), np.uint64)
    wide[:n, 0], wide[:n, 1] = found, _mix(found + _C[0])
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 255, 16), axis=2)
    return (bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64) * 2 > n).astype(np.uint8)


def sketch(found: np.ndarray) -> bytes:
    """Of a set's hashes, whether an odd number falls on each bit of a power of two: twice the set's size, and FOLDED, or more."""
    bits = 1 << max(FOLDED.bit_length() - 1, (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(it):
    """(node, n, odd, texts) -> (node, n, fold): sketches of FOLDED bits, which differ in no more bits than the sets in shingles.
    n is -1 for a node of several texts, which sizes and sketches don't tell from others."""
    for batch in it:
        folds = [np.bitwise_xor.reduce(np.frombuffer(v.as_buffer(), np.uint64).reshape(-1, FOLDED // 64), axis=0).tobytes() for v in batch.column("odd")]
        n = np.where(batch.column("texts").to_numpy() > 1, -1, batch.column("n").to_numpy())
        yield pa.record_batch([batch.column("node"), pa.array(n.astype(np.int32)), pa.array(folds, pa.binary())], names=["node", "n", "fold"])


def _near(threshold: float):
    """(a, b, n_a, n_b, odd_a, odd_b) -> the pairs that may reach the threshold: sketches, the larger folded, differ in no more
    bits than the sets in shingles."""

    def run(it):
        for batch in it:
            keep = []
            for n, m, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("odd_a"), batch.column("odd_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) if len(v) > least else v for v in (x, y))
                keep.append(min(n, m) >= threshold * max(n, m) - 1e-6 and int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (1 - threshold) / (1 + threshold) + 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def word_key(text: Column) -> Column:
    """A digest of the text's words: equal for texts that differ in case, punctuation or white space alone."""
    return F.md5(normal(text))


def _differ(both: int, x: int, y: int) -> float:
    """The chance that a bit differs between sets that share so many shingles, and have x and y more."""

    def chance(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) for i in range(n + 1)]) / 2.0**n

    def set_(extra: int) -> np.ndarray:
        ones = np.arange(both + 1)[:, None] + np.arange(extra + 1)
        return (ones * 2 > both + extra) @ chance(extra)

    a, b = set_(x), set_(y)
    return float(chance(both) @ (a * (1 - b) + b * (1 - a)))


@lru_cache(8)
def apart(threshold: float = SIMILARITY, low: int = 1) -> float:
    """The share of bits in which a pair at the threshold differs: the most for any sizes, the larger set's from low on."""
    most = math.acos(2 * threshold / (1 + threshold)) / math.pi  # of large sets
    for n in range(low, max(low, SHORT) + 33):
        for m in range(max(1, math.ceil(threshold * n - 1e-9)), n + 1):
            both = math.ceil((n + m) * threshold / (1 + threshold) - 1e-9)
            if both <= m:
                most = max(most, _differ(both, m - both, n - both))
    return most


def far(threshold: float = SIMILARITY, low: int = 1) -> int:
    """Bits in which a pair at the threshold differs: the mean and SIGMAS standard deviations, for the larger set's size from low on."""
    p = apart(threshold, low)
    return math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


def recall(k: int, tries: int, threshold: float = SIMILARITY) -> float:
    """The chance that a pair at the threshold, the larger of more than SHORT shingles, shares a prefix of k bits in
    some of so many tries and is within far(): over the number of bits that differ, from which all tries draw alike."""
    p, total = apart(threshold, SHORT + 1), 0.0
    for d in range(far(threshold, SHORT + 1) + 1):
        miss = 1 - math.comb(BITS - d, k) / math.comb(BITS, k)
        total += math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) * (1 - miss**tries)
    return total


@lru_cache(64)
def shape(n: int, threshold: float = SIMILARITY) -> tuple[int, int]:
    """(last depth, tries) for n nodes: DEPTH bits, or as many as leave CROWD nodes to a prefix on average; and as many tries
    as find a pair at the threshold there with probability RECALL. At thresholds that BITS bits cannot serve so, less deep."""
    k = max(DEPTH, math.ceil(math.log2(max(1, n) / CROWD)))
    while k > 1 and recall(k, 4096, threshold) < RECALL:
        k -= 1
    low, high = 1, 4096
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(k, mid, threshold) >= RECALL else (mid + 1, high)
    return k, low


def _signed(it):
    for batch in it:
        found = [shingles(t.as_py()) for t in batch.column("words")]
        sig = np.stack([np.packbits(simhash(f)) for f in found] or [np.zeros(16, np.uint8)])[: batch.num_rows].view(np.int64)
        n = pa.array([len(f) for f in found], pa.int32())
        odd = pa.array([sketch(f) for f in found], pa.binary())
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(sig[:, 0]), pa.array(sig[:, 1]), n, odd], names=["doc_id", "key", "s0", "s1", "n", "odd"])


@lru_cache(8)
def sizes(threshold: float = SIMILARITY) -> np.ndarray:
    """The largest set of each class of size. A set and one at the threshold are of the same class or one that cuts() gives."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * max(1.05, 1 / threshold))))
    return np.array(out)


def cuts(n: int, threshold: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(class, d + 1, parts) for each class in which the larger set of a pair may be, if a set of n shingles is one of the two."""
    most, out = sizes(threshold), []
    c = int(np.searchsorted(most, n))
    while not out or threshold * (most[c - 1] + 1) <= n + 1e-6:
        need = int(2 * int(most[c]) * (1 - threshold) / (1 + threshold) + 1e-6) + 1
        out.append((c, need, need + max(1, need // 5)))
        c += 1
    return out


def tokens(found: list[np.ndarray], threshold: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(index of a set, hash of one of its parts): two sets at the threshold have some hash in common.

    Of a class all sets are parted alike. Two sets that differ in d shingles at most have all parts but d in common;
    by one order of all possible parts, here fuller ones first and empty ones last, that is one of the first d + 1 of each
    (prefix filtering)."""
    jobs = [(i, *cut) for i, f in enumerate(found) for cut in cuts(len(f), threshold)]
    if not jobs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, kind, need, parts = (np.array(x, np.int64) for x in zip(*jobs))
    lengths = np.array([len(found[i]) for i in at])
    job = np.repeat(np.arange(len(jobs)), lengths)
    x = np.concatenate([found[i] for i in at])
    part = ((x >> np.uint64(32)) * parts.astype(np.uint64)[job] >> np.uint64(32)).astype(np.int64)  # sets are sorted: so are parts
    start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (job[1:] != job[:-1])])
    held = np.diff(np.r_[start, len(x)])
    job, part = job[start], part[start]
    code = _mix(np.add.reduceat(_mix(x ^ _C[1]), start) + _mix(kind.astype(np.uint64)[job] * _C[2] + part.astype(np.uint64) * _C[3]))
    order = np.lexsort((code >> np.uint64(24) | (np.uint64(255) - np.minimum(held, 255).astype(np.uint64)) << np.uint64(40), job))
    first = np.flatnonzero(np.r_[True, job[1:] != job[:-1]])
    there = np.diff(np.r_[first, len(job)])
    keep = order[np.arange(len(job)) - np.repeat(first, there) < np.repeat(need, there)]
    ids, codes = [at[job[keep]]], [code[keep]]
    for j in np.flatnonzero(there < need):  # too few parts hold anything: empty ones by number
        empty = np.setdiff1d(np.arange(parts[j]), part[first[j] : first[j] + there[j]])[: need[j] - there[j]].astype(np.uint64)
        ids.append(np.full(len(empty), at[j])), codes.append(_mix(_mix(kind.astype(np.uint64)[j : j + 1] * _C[2] + empty * _C[3])))
    return np.concatenate(ids), np.concatenate(codes)


def _parted(parts: int, threshold: float):
    """(node, label, words) -> (part, payload): the tokens of CHUNK documents, in as many packs as there are parts. A pack holds
    32 bits of each token, and by planes of bytes, which compress, nodes and what their labels differ in."""

    def run(it):
        for batch in it:
            for start in range(0, batch.num_rows, CHUNK):
                own = batch.slice(start, CHUNK)
                node, label = own.column("node").to_numpy(), own.column("label").to_numpy()
                i, code = tokens([shingles(t.as_py()) for t in own.column("words")], threshold)
                to = ((code >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                i, code, ends = i[order], code[order].astype(np.uint32), np.cumsum(np.bincount(to, minlength=parts))
                node, other = node[i], node[i] ^ label[i]
                packs = [b"".join([code[a:b].tobytes(), *(np.ascontiguousarray(x[a:b].view(np.uint8).reshape(-1, 8).T).tobytes() for x in (node, other))]) for a, b in zip(np.r_[0, ends[:-1]], ends)]
                some = [p for p in range(parts) if packs[p]]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([packs[p] for p in some], pa.binary())], names=["part", "payload"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """All packs of a part -> (bucket, node) of the tokens that nodes of different labels share."""
    codes, nodes, labels = [], [], []
    for x in table.column("payload"):
        x = np.frombuffer(x.as_buffer(), np.uint8)
        n = len(x) // 20
        codes.append(x[: 4 * n].view(np.uint32))
        node, other = (np.ascontiguousarray(x[a * n : (a + 8) * n].reshape(8, n).T).view(np.int64)[:, 0] for a in (4, 12))
        nodes.append(node), labels.append(node ^ other)
    code, node, label = (np.concatenate(x) for x in (codes, nodes, labels))
    order = np.argsort(code, kind="stable")
    code, node, label = code[order], node[order], label[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    some = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
    keep = np.repeat(some, np.diff(np.r_[start, len(code)]))
    bucket = (np.int64(table.column("part")[0].as_py()) << 32) + code[keep].astype(np.int64)
    return pa.table({"bucket": bucket, "node": node[keep]})


def _sig(batch) -> np.ndarray:
    return np.stack([batch.column("s0").to_numpy(), batch.column("s1").to_numpy()], axis=1)


def _leaves(k: int, tries: int):
    """Nodes -> their prefix of k bits in each trie (leaf), and the trie's next DEEPER bits, the first one lowest (deep)."""
    order = [np.random.default_rng(t).permutation(BITS)[: k + DEEPER] for t in range(tries)]
    power = 1 << np.arange(k + DEEPER, dtype=np.int64)
    low = (1 << k) - 1

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = _sig(part)
                bits = np.unpackbits(sig.view(np.uint8), axis=1)
                path = np.stack([bits[:, o].astype(np.int64) @ power for o in order], axis=1)
                leaf = (path & low) + (np.arange(tries, dtype=np.int64) << 40)
                columns = [part.column("node").to_numpy().repeat(tries), leaf.ravel(), (path >> k).astype(np.int32).ravel(), sig[:, 0].repeat(tries), sig[:, 1].repeat(tries)]
                few = part.column("few").to_numpy(zero_copy_only=False).repeat(tries)
                yield pa.record_batch([*(pa.array(c) for c in columns), pa.array(few, pa.bool_())], names=["node", "leaf", "deep", "s0", "s1", "few"])

    return run


def _folds(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("fold").to_pylist()), np.uint64).reshape(-1, FOLDED // 64)


def _runs(it, extra: str = "few"):
    """Batches of a partition sorted by bucket -> (bucket, side, node, label, extra, bits) that end where a bucket ends."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append([*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "side", "node", "label", extra)), _sig(batch).view(np.uint64) if extra == "few" else _folds(batch)])
        rows += batch.num_rows
        if rows < 8192:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        end = int(np.searchsorted(whole[0], whole[0][-1]))
        if end:
            yield [x[:end] for x in whole]
        held, rows = [[x[end:] for x in whole]], len(whole[0]) - end
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows differ, word by word."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16)
    for w in range(a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def _beyond(bits: np.ndarray, x: np.ndarray, y: np.ndarray, limits) -> np.ndarray:
    """Which pairs cannot be alike. limits: of bits (the second if one of the two has few shingles: x, y); or the threshold, with
    sizes x, y, of which -1 is any: sets at the threshold differ in no more shingles, and folded sketches in no more bits."""
    if isinstance(limits, tuple):
        return (bits > limits[0]) & ~x & ~y | (bits > limits[1])
    x, y = x.astype(np.int64), y.astype(np.int64)
    bad = (bits > (x + y) * (1 - limits) / (1 + limits) + 1e-6) | (np.minimum(x, y) < limits * np.maximum(x, y) - 1e-6)
    return bad & (x >= 0) & (y >= 0)


def _nearest(side, node, label, few, sig, width: int, limits):
    """Of one bucket: (i, j) with j among the width nearest of i, and of width 1 also the least node that is near enough;
    and whether some i has more than these."""
    left, right, more = [], [], False
    for at in range(0, len(node), 256):
        rows = slice(at, at + 256)
        bits = _count(sig[rows, None], sig[None])
        bad = _beyond(bits, few[rows, None], few[None], limits)
        bad |= (label[rows, None] == label[None]) | (node[rows, None] == node[None]) | ((side[rows, None] != 0) & (side[rows, None] == side[None]))
        bits[bad] = np.iinfo(bits.dtype).max
        count = len(node) - bad.sum(1)
        i = np.flatnonzero(count)
        if not len(i):
            continue
        if width == 1:
            near, hub = bits[i].argmin(1), np.where(bad[i], np.iinfo(np.int64).max, node[None]).argmin(1)
            left += [i + at, i + at]
            right += [near, hub]
            more |= bool((count[i] > 1 + (near != hub)).any())
        else:
            near = np.argsort(bits[i], axis=1, kind="stable")[:, :width]
            ok = np.arange(near.shape[1]) < count[i, None]
            left.append(np.repeat(i + at, ok.sum(1)))
            right.append(near[ok])
            more |= bool((count > width).any())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), more


def _propose(width: int, limits):
    """Sorted (bucket, side, node, label, few, s0, s1), or (..., n, fold), -> pairs (a, b, null) that are not _beyond(limits)
    and of different labels: all of a small bucket, and each document's nearest width of a larger one, with
    a row (null, null, bucket) if those were not all.

    side: 0 in a bucket of its own; 1 and 2 in a pair of blocks, which meet each other alone."""

    def run(it):
        for bucket, side, node, label, few, sig in _runs(it, "few" if isinstance(limits, tuple) else "n"):
            n = len(bucket)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, n])
            end = np.repeat(starts + sizes, sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            at, a, b, step, more = np.flatnonzero(small), [], [], 0, []
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                to = at + step
                ok = ~_beyond(_count(sig[at], sig[to]), few[at], few[to], limits)
                ok &= (label[at] != label[to]) & (node[at] != node[to]) & ((side[at] == 0) | (side[at] != side[to]))
                a.append(at[ok]), b.append(to[ok])
            for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                x = slice(start, start + size)
                i, j, rest = _nearest(side[x], node[x], label[x], few[x], sig[x], width, limits)
                a.append(i + start), b.append(j + start)
                if rest:
                    more.append(int(bucket[start]))
            a, b = node[np.concatenate(a)], node[np.concatenate(b)]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "rest"])
            if more:
                yield pa.record_batch([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more, pa.int64())], names=["a", "b", "rest"])

    return run


def _sets(it):
    for batch in it:
        yield pa.record_batch([batch.column("node"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("words")], pa.binary())], names=["node", "set"])


def _verified(threshold: float):
    def run(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                i = np.searchsorted(y, x)
                both = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b"), mask], names=["a", "b", "linked"])

    return run


def _shared(ws: Workspace, texts: DataFrame, nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    """(bucket, side, node, n, fold): what nodes of different labels share. Crowded buckets come as pairs of blocks."""
    parts = max(1, math.ceil(total / PART))
    packs = texts.select("node", "label", "words").mapInArrow(_parted(parts, threshold), "part int, payload binary")
    met = ws.save(packs.groupBy("part").applyInArrow(_met, "bucket long, node long").distinct(), "met")
    crowds = met.groupBy(F.col("bucket").alias("d")).count().filter(F.col("count") > BUCKET).select("d", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks"))
    one = met.join(crowds, F.col("bucket") == F.col("d"), "left_anti").select("node", "bucket", F.lit(0).alias("side"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    many = met.join(crowds, F.col("bucket") == F.col("d")).select("node", "bucket", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    many = many.select("node", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), side.alias("side"))
    bits = nodes.groupBy("node").agg(F.min("n").alias("n"), F.min("odd").alias("odd"), F.count(F.lit(1)).alias("texts")).mapInArrow(_folded, "node long, n int, fold binary")
    return ws.save(one.unionByName(many).join(bits, "node"), "shared")


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, leader, class_id) for every row of docs(doc_id, text).

    class_id is the least doc_id of the class, leader whether this is it. Classes are connected by verified links.
    Null text is as empty, and all empty texts are one class. A null doc_id has no class: it is null, and the row
    neither finds nor leads others. Rows that share a doc_id share its class, whatever their texts. Other columns are left out.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("words")).select("doc_id", F.md5("words").alias("key"), "words")
    signed = ws.save(text.mapInArrow(_signed, "doc_id long, key string, s0 long, s1 long, n int, odd binary"), "signed")
    # a doc_id with several texts is one node with as many rows, which link whatever one of them links
    nodes = signed.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.max("s0").alias("s0"), F.max("s1").alias("s1"), F.max("n").alias("n"), F.max("odd").alias("odd"))
    nodes = ws.save(nodes, "nodes")
    stat = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles")).first()
    depth, tries = shape(stat.nodes, threshold)
    few = nodes.select("node", "s0", "s1", (F.col("n") <= SHORT).alias("few"))
    leaves = ws.save(few.mapInArrow(_leaves(depth, min(tries, TRIES)), "node long, leaf long, deep int, s0 long, s1 long, few boolean"), "leaves")
    dense = leaves.groupBy("leaf").count().filter(F.col("count") > LEAF)
    more_bits = F.least(F.ceil(F.log2(F.col("count") / LEAF)) + 1, F.lit(DEEPER)).cast("int")
    dense = dense.select(F.col("leaf").alias("d"), more_bits.alias("bits"), F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks"))
    met = leaves.join(dense, F.col("leaf") == F.col("d"), "left")
    # leaves: of a dense prefix by further bits, and a crowd that none of them parts by hash of the node
    deeper = F.xxhash64("leaf", F.expr("deep & (shiftleft(1, bits) - 1)"), F.pmod(F.xxhash64("node"), "blocks"))
    first = met.select("node", "s0", "s1", "few", F.when(F.col("bits").isNull(), F.col("leaf")).otherwise(deeper).alias("bucket"), F.lit(0).alias("side"))

    def words_of(keyed: DataFrame, part: DataFrame) -> DataFrame:
        """keyed(node, key, ...) with the words of its texts, out of part of the documents."""
        joined = part.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(keyed, F.col("doc_id") == F.col("node"))
        return joined.withColumn("words", normal(F.col("text"))).drop("text", "doc_id").filter(F.md5("words") == F.col("key"))

    def verify(fresh: DataFrame, step: int) -> DataFrame:
        """(a, b, linked) of the pairs whose sketches are near. Only texts of a bounded number of hashes of ids are shuffled."""
        half = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
        drawn = fresh.join(half("a"), "a").join(half("b"), "b").select("a", "b", "n_a", "n_b", "odd_a", "odd_b")
        fresh = ws.save(drawn.mapInArrow(_near(threshold), "a long, b long").distinct(), f"near-{step}")
        needed = fresh.select(F.col("a").alias("node")).union(fresh.select("b")).distinct()
        needed = ws.save(nodes.select("node", "key").join(needed, "node", "left_semi"), f"needed-{step}")
        short = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(HASHES))
        some = docs.withColumn("_cf_hash", short("doc_id")).join(F.broadcast(needed.select(short("node").alias("_cf_hash")).distinct()), "_cf_hash", "left_semi")
        sets = ws.save(words_of(needed, some).select("node", "words").mapInArrow(_sets, "node long, set binary"), f"sets-{step}")
        both = fresh.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        checked = ws.save(both.mapInArrow(_verified(threshold), "a long, b long, linked boolean").distinct(), f"checked-{step}")
        ws.drop(f"needed-{step}"), ws.drop(f"sets-{step}")
        return checked

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))

    roots = tested = again = None
    width, step = 1, 0
    while True:
        if roots is None:
            rows, limits = first.withColumn("label", F.col("node")), (far(threshold, SHORT + 1), far(threshold))
        else:
            rows, limits = labelled(shared if again is None else shared.join(again, "bucket", "left_semi")), threshold
        rows = rows.select("bucket", "side", "node", "label", *(("few", "s0", "s1") if isinstance(limits, tuple) else ("n", "fold"))).repartition("bucket").sortWithinPartitions("bucket")
        pairs = ws.save(rows.mapInArrow(_propose(width, limits), "a long, b long, rest long").distinct(), f"pairs-{step}")
        fresh = pairs.filter("a is not null").select("a", "b")
        if tested is not None:
            fresh = fresh.join(tested, ["a", "b"], "left_anti")
        fresh = ws.save(fresh, f"fresh-{step}")  # as a table its size is known, and few pairs are broadcast to the sets
        checked = verify(fresh, step)
        tested = fresh if tested is None else tested.union(fresh)
        links = checked.filter("linked").select("a", "b")
        if roots is not None:
            links = links.union(roots.select("node", "root"))
        roots = components(ws, links, f"classes-{step}")
        if step == 0:
            shared = _shared(ws, words_of(labelled(nodes.select("node", "key")), docs), nodes, stat.shingles or 0, threshold)
            ws.drop("leaves")
        else:
            again = ws.save(pairs.filter("rest is not null").select(F.col("rest").alias("bucket")), f"again-{step}")
            if again.isEmpty():  # at the latest when the width is a bucket's size
                break
            width = WIDTH if width == 1 else width * 4
        ws.drop(f"pairs-{step}")
        step += 1
    member = nodes.join(roots, "node", "left").select("key", F.col("node").alias("_node"), F.coalesce("root", "node").alias("_root"))
    out = signed.select("doc_id", "key").join(member, "key", "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "key", (own & (F.col("doc_id") == F.col("_root"))).alias("leader"), F.when(own, F.col("_root")).alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, one of each class (the least doc_id; of its repeated rows one). Rows without a doc_id all stay."""
    from pyspark.sql import Window

    leaders = classes(docs, threshold).filter("leader").select(F.col("key").alias("_cf_k"), F.col("doc_id").alias("_cf_d")).distinct()
    keyed = docs.withColumn("_cf_key", word_key(F.col("text")))
    kept = keyed.join(leaders, (F.col("_cf_key") == F.col("_cf_k")) & (F.col("doc_id") == F.col("_cf_d")))
    kept = kept.withColumn("_cf_nth", F.row_number().over(Window.partitionBy("_cf_k", "_cf_d").orderBy(F.lit(1)))).filter("_cf_nth = 1")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op10_simhash_near_dedup(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "leader")
