"""License scan in DataFrame functions alone: MinHash bands over overlapping windows, then exact containment.

A template matches where a window of a document holds SIMILARITY of its five-word shingles at least. So the window
misses a fifth of them at most, and holds a word of any set that hits more than that fifth (the template's anchors,
few and long words, chosen once). Only windows over anchors are built; the rest of the corpus cannot match, and one
pass over the lower-cased text tells. No occurrence is lost by that.

For each length class of templates, windows begin at every STEP-th part of the class's length and hold any occurrence
whole. A window over an occurrence of containment 0.8 then has a Jaccard similarity of 0.49 with its template at the
least, mostly above 0.75; BANDS bands of ROWS hashes collide with probability 0.995 and above 0.9999. Templates are
retrieved by band, and every retrieved pair is verified by the exact share of the template's shingles (as 64-bit hashes
of their words, made once for each place of a text and sliced for its windows).

Texts are cut into segments of SEGMENT words that overlap by the longest window, each a row of its own, so a row's
windows don't grow with the text. The templates' bands and shingles are two small tables, with a broadcast hint up to
MAX_BROADCAST bytes, as counted, and joined by key beyond. Hot documents and hot licenses stay rows of a stream; the
result is combined map-side.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfind.llm.license_texts import LICENSES

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 2
STEP = 4
SEGMENT = 2048
MAX_BROADCAST = 8 << 20
MAX_LITERAL = 1000  # templates whose bands are literals of the plan


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(texts: list[str], similarity: float = SIMILARITY) -> dict[str, set[str]]:
    """For each text (its words, joined by blanks) words that hit more of its shingles than a match may miss: greedily
    those that hit many, long ones first."""
    open_, need = {}, {}
    for text in texts:
        w = text.split()
        open_[text] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
        need[text] = int((1 - similarity) * len(open_[text]) + 1e-9) + 1
    out: dict[str, set[str]] = {text: set() for text in texts}
    while live := [t for t in texts if need[t] > 0]:
        gain: dict[str, float] = {}
        for t in live:
            hits: dict[str, int] = {}
            for s in open_[t]:
                for w in set(s):
                    hits[w] = hits.get(w, 0) + 1
            for w, n in hits.items():
                gain[w] = gain.get(w, 0) + min(n, need[t]) / need[t] * max(len(w) - 2, 0.1) ** 2
        best = min(gain, key=lambda w: (-gain[w], w))
        for t in live:
            hit = {s for s in open_[t] if best in s}
            if hit:
                out[t].add(best)
                open_[t] -= hit
                need[t] -= len(hit)
    return out


def length_class(n: int) -> int:
    """Lengths up to 16 words are classes of their own; longer ones share one up to an eighth longer."""
    c = 16
    if n <= c:
        return max(n, 1)
    while c < n:
        c += c // 8
    return c


def _shingles(words: Column) -> Column:
    """A hash for each five words in a row; of fewer words in all, one."""
    n = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def _bands(shingles: Column) -> Column:
    least = lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))


def word_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hint(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, license, containment, word_start) for every license of which a document holds a text, with the best
    share of a text's shingles and the first window that has it. templates: license -> its text or texts.

    Kindred texts, such as the notices of two versions, match each other's documents with a lower containment.

    Null and empty texts match nothing; rows that share a doc_id (null is one too) are one; texts without a word are
    left out, and without templates or documents the result is empty. Other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    named = [(k, " ".join(_words(t))) for k, v in (LICENSES if templates is None else templates).items() for t in ([v] if isinstance(v, str) else v)]
    named = [(k, t) for k, t in dict.fromkeys(named) if t]
    if not named:
        return spark.createDataFrame([], "doc_id long, license string, containment double, word_start int")
    rows = [(i, k, t, length_class(len(t.split()))) for i, (k, t) in enumerate(named)]
    known = spark.createDataFrame(rows, "id int, license string, words string, class int").withColumn("template", F.array_distinct(_shingles(F.split("words", " "))))
    bands = _hint(known.select("class", F.explode(_bands(F.col("template"))).alias("band"), "id"), 24 * BANDS * len(rows))
    known = _hint(known.select("id", "license", "template"), sum(8 * len(t.split()) + len(k.encode()) + 64 for k, t in named))
    hit = anchors(list({t for _, t in named}), similarity)
    words_of = sorted(set().union(*hit.values()))
    by_class: dict[int, set[str]] = {}
    for _, _, t, c in rows:
        by_class.setdefault(c, set()).update(hit[t])
    steps = {c: max(1, c // STEP) for c in by_class}
    overlap = max(c + steps[c] for c in by_class)

    texts = docs.select("doc_id", "text").filter(F.lower("text").rlike("|".join(map(re.escape, words_of))))
    texts = texts.select("doc_id", word_column(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT)), lambda b: F.struct(b.alias("base"), F.slice("w", b + 1, SEGMENT + overlap).alias("w")))
    # only texts with anchors come this far; their segments are spread, so a long text is no one task's work
    texts = texts.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.base", "s.w").repartition("doc_id", "base")
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(words_of), F.struct(i.alias("i"), x.alias("x")))), lambda p: p.isNotNull())
    texts = texts.withColumn("at", at).filter(F.size("at") > 0).withColumn("g", _shingles(F.col("w")))

    def windows(c: Column) -> Column:
        """Of one length class, a struct (n, step, words)."""
        n, step = c["n"], c["step"]
        grid = lambda p: F.sequence(F.greatest(F.floor((p["i"] - n + 1) / step) * step, F.lit(0)).cast("int"), (F.floor(p["i"] / step) * step).cast("int"), step)
        mine = F.filter("at", lambda p: F.array_contains(c["words"], p["x"]))
        starts = F.filter(F.array_distinct(F.flatten(F.transform(mine, grid))), lambda s: s < SEGMENT)
        # the shingles that lie in the window; a text that ends before has its own last ones
        inside = lambda s: F.when(n < SHINGLE, F.array(F.xxhash64(F.slice("w", s + 1, n)))).otherwise(F.slice("g", s + 1, n + step - SHINGLE))
        return F.transform(starts, lambda s: F.struct(n.alias("class"), s.alias("start"), inside(s).alias("window")))

    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))  # noqa: E731 - letters and digits alone
    classes = F.expr("array(" + ", ".join(f"named_struct('n', {c}, 'step', {steps[c]}, 'words', array({quoted(by_class[c])}))" for c in sorted(by_class)) + ")")
    seen = texts.select("doc_id", "base", F.explode(F.flatten(F.transform(classes, windows))).alias("x"))
    seen = seen.select("doc_id", "x.class", (F.col("base") + F.col("x.start")).alias("start"), "x.window").filter(F.size("window") > 0)
    banded = seen.withColumn("bands", F.array_distinct(_bands(F.col("window"))))
    if len(rows) <= MAX_LITERAL:  # most windows share no band with any template: they need not be exploded
        there = ", ".join(f"{r.band}L" if r.band > -(1 << 63) else f"({r.band + 1}L - 1L)" for r in bands.select("band").distinct().collect())
        banded = banded.withColumn("bands", F.expr(f"filter(bands, b -> b in ({there}))"))
    met = banded.withColumn("band", F.explode("bands")).drop("bands").join(bands, ["class", "band"]).join(known, "id")
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    met = met.select("doc_id", "license", "start", share.alias("share")).filter(F.col("share") >= similarity)
    best = met.groupBy("doc_id", "license", "share").agg(F.min("start").alias("start")).groupBy("doc_id", "license")
    return best.agg(F.max("share").alias("containment"), F.min_by("start", -F.col("share")).alias("word_start"))


def op9_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
