import random
import struct
import zlib
from bisect import bisect_left, insort

import pytest

from cinderfind.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def brute_bins(lengths, size):
    """Bins of the document-by-document best-fit decreasing."""
    rooms = []
    n = 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            room = size
        else:
            room = rooms.pop(i)
        insort(rooms, room - x)
    return n, sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for size in (10, 64, 2048):
        for _ in range(30):
            lengths = [rng.randint(1, rng.choice([3, size])) for _ in range(rng.randrange(0, 400))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            used = {}
            for length, first, bin_, per, offset in (runs := packing.plan(counts, size)):
                left = min([r[1] for r in runs if r[0] == length and r[1] > first], default=counts[length]) - first
                for i in range(left):
                    used.setdefault(bin_ + i // per, []).append((offset + i % per * length, length))
            for pieces in used.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= size
            n, rooms = brute_bins(lengths, size)
            assert len(used) == n and sorted(size - sum(x for _, x in p) for p in used.values()) == rooms


def test_tightest():
    t = packing.Tightest(100)
    open_, rng = set(), random.Random(3)
    for _ in range(3000):
        room = rng.randint(0, 100)
        if room in open_:
            t.pop(room), open_.discard(room)
        else:
            t.push(room, (0, 1)), open_.add(room)
        n = rng.randint(1, 100)
        assert t.find(n) == min((r for r in open_ if r >= n), default=-1)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids, rng = packing.Ids(tok), random.Random(5)
    texts = ["It's I'LL don't x²½ 12a3 'S 's't ÀÉİ a\x1fb c\x85d\xa0e\x00f <|endoftext|> 日本 é ŉ ſ _ __a_b", "", " \n", "Σας ΣΑΣ ς"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x180), rng.randrange(0x80), rng.randrange(0x3000)])) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids.ids(t) == struct.pack(f"<{len(want)}I", *want), repr(t)


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = [(1, "the cat " * 300, "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "a b", "z"), (5, "one", "w")] + [(10 + i, "word " * (i % 7), "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = packing.pack(df, PATH, 64).collect()
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == brute_bins([w[3] for w in want], 64)[0]
    assert packing.pack(df.limit(0), PATH).count() == 0
