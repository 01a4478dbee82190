import random

import numpy as np

from cinderfind.llm import substring_dedup as S


def sentence(rng, n=None):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n or rng.randint(4, 18))]
    return " ".join(words).capitalize() + "."


def winnowed(words):
    """In plain Python: of each GAP pairs of words in a row, the last one of least hash."""
    code, prime, n = [S._words()[w] for w in words], int(S._P), len(words)
    low = (1 << max(1, n.bit_length())) - 1

    def mixed(i):
        x = (code[i] + (code[i + 1] * prime if i + 1 < n else 0)) % (1 << 64)
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64) & ~low

    hashes = [mixed(i) for i in range(n)]
    width = S.GAP
    while width > 1 and width > n:
        width //= 2
    return {min(range(i, i + width), key=lambda k: (hashes[k], -k)) for i in range(n - width + 1)} if n else set()


def plain_windows(text):
    """Windows as word tuples, in plain Python."""
    words, starts = [], set()
    for line in text.lower().split("\n"):
        starts.add(len(words))
        words += line.split()
    starts |= winnowed(words)
    begins = [i for i in range(len(words)) if i in starts]
    out = []
    for i in begins:
        end = next((b for b in [*begins, len(words)] if b >= i + S.WINDOW), len(words))
        out.append((i, end, tuple(words[i:end])))
    return out, len(words)


def brute(rows):
    first = {}
    for i, t in rows:
        for *_, w in plain_windows(t or "")[0]:
            first[w] = min(first.get(w, 1 << 63), i if i is not None else 1 << 63)
    out = []
    for i, t in rows:
        rank = i if i is not None else 1 << 63
        found, n = plain_windows(t or "")
        copied, seen = [False] * n, set()
        for a, b, w in found:
            if first[w] < rank or w in seen:
                copied[a:b] = [True] * (b - a)
            seen.add(w)
        runs, a = [], None
        for k, c in enumerate([*copied, False]):
            if c and a is None:
                a = k
            elif not c and a is not None:
                if k - a >= S.MIN_WORDS:
                    runs.append((a, k))
                a = None
        out.append((i, t, runs))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(sentence(rng) for _ in range(n))
    passage = " ".join(text(9).split()[3:60])  # begins and ends inside sentences
    heading = "Same short heading here."
    rows = [(i, heading + "\n" + text(12)) for i in range(40)]
    for i in (5, 9, 23):
        words = rows[i][1].split(" ")
        at = len(words) // 2
        rows[i] = (i, " ".join(words[:at]) + " " + passage + " " + " ".join(words[at:]))
    rows += [(50, rows[2][1]), (51, None), (52, ""), (53, " \n "), (None, rows[3][1]), (2, rows[2][1]), (60, "Again and again we say this very thing here.\n" * 60)]
    return rows, passage


def test_against_brute_force(spark):
    rows, passage = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string")
    got = S.dedup(df).collect()
    want = []
    for i, t, runs in brute(rows):
        at, p = [], 0
        for w in (t or "").split():
            p = t.index(w, p)
            at.append(p)
            p += len(w)
        at.append(len(t or ""))
        want.append((i, [(at[a] if a else 0, at[b]) for a, b in runs]))
    assert sorted(((r.doc_id, [tuple(s) for s in r.removed]) for r in got), key=str) == sorted(want, key=str)
    original = {i: t for i, t in rows}
    for r in got:
        t = original[r.doc_id]
        for a, b in reversed(r.removed):
            t = t[:a] + t[b:]
        assert t == r.text
    by = {r.doc_id: r for r in got}
    middle = " ".join(passage.split()[16:40])
    assert middle in by[5].text and middle not in by[9].text and middle not in by[23].text
    assert not by[2].removed and by[50].text == "" and by[None].text == "" and by[51].text is None
    assert all(not by[i].removed for i in range(40) if i not in (9, 23))  # clean, and its short heading stays
    assert by[60].text.count("Again") <= 2


def test_rows_without_ids(spark):
    """They come last, in the order of their texts' hashes, and no two are one document."""
    rng = random.Random(4)
    passage = " ".join(sentence(rng) for _ in range(12))
    rows = [(None, " ".join(sentence(rng) for _ in range(6)) + "\n" + passage) for _ in range(30)] + [(None, None), (None, "")]
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(passage in (r.text or "") for r in got) == 1 and sum(len(r.removed) for r in got) == 29


def test_every_passage_of_sixty_words(spark):
    rng = random.Random(6)
    for _ in range(200):
        passage, other = sentence(rng, 60), [sentence(rng, 40) for _ in range(4)]
        later = S.windows(f"{other[0]} {passage} {other[1]}")[2]
        found = S.runs(f"{other[2]} {passage} {other[3]}", later)
        assert len(found) == 1 and 40 <= found[0][0] <= 58 and found[0][1] <= 101


def test_query(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, removed string").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op5_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "n_removed", "removed_chars", "removed"] and got.count() == len(rows)


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests_are_those_of_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "B ", "\n", "Éa ", "word ", "x! ", "  ", "ß "]) for _ in range(rng.randrange(120))) for _ in range(200)]
    known = {}
    for t in [*texts, *texts[:20]]:
        begin, end, digest, n = S.windows(t)
        plain, m = plain_windows(t)
        assert n == m and [(a, b) for a, b, _ in plain] == list(zip(begin, end))
        for d, (*_, w) in zip(digest, plain):
            assert known.setdefault(w, d) == d
    assert len(set(known.values())) == len(known)
    assert len(S.windows("word " * 100_000)[0]) > 0 and np.all(S.windows("")[0] == 0)
