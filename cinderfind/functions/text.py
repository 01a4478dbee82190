"""Text functions as Columns: words, lines, tokens, hashes and projections. All stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, below U+0250, with their base letters."""
    pairs = []
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def count_words(text: Column) -> Column:
    return F.size(words(text))


def tail_words(text: Column, n: int) -> Column:
    """The last n words, joined by blanks; all if there are fewer."""
    w = words(text)
    keep = F.least(F.size(w), F.lit(n))
    return F.when(keep > 0, F.array_join(F.slice(w, F.greatest(F.size(w) - keep, F.lit(0)) + 1, keep), " ")).otherwise(F.lit(""))


def lines(text: Column) -> Column:
    """Lines at every kind of line end; none after the last one."""
    parts = F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column, fold: bool = False) -> Column:
    """Index terms: lower-cased runs of letters and numbers; fold also takes accents off."""
    low = F.lower(text)
    if fold:
        low = F.translate(low, *_accents())
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sanitized(part: Column) -> Column:
    """As model.sanitize, in a column; what has nothing left raises."""
    out = F.trim(F.regexp_replace(F.lower(part.cast("string")), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", F.raise_error(F.lit("a part of a space id has no letter or digit"))).otherwise(out)


def space_id(*parts: Column) -> Column:
    return F.concat_ws("__", *map(sanitized, parts))


def semantic_projection(fields: Column) -> Column:
    """array<struct<label, value>> -> "label: value" lines in order, blank values left out; none left raises."""
    shown = F.filter(fields, lambda f: F.length(strip(f["value"])) > 0)
    text = F.array_join(F.transform(shown, lambda f: F.concat(f["label"], F.lit(": "), strip(f["value"]))), "\n")
    return F.when(F.size(shown) > 0, text).otherwise(F.raise_error(F.lit("a record has no text to index")))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s::chunk-%04d", doc_id, index)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for empty text."""
    n = F.char_length(text)
    return F.when(n > 0, F.greatest(F.ceil(n / 4), F.lit(1))).otherwise(0).cast("long")
