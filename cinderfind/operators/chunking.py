"""Chunking: whole records, word windows, paragraph-aware packing and Markdown sections.

Word windows and section splitting are expressions and windows over lines; packing is a greedy fold with a carried
overlap, which runs over Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderfind.functions import text as T

MAX_WORDS = 900
OVERLAP = 75
HEADING = r"^([#]{1,6})[ \t]+(.+?)[ \t]*[#]*[ \t]*$"
_WORD = re.compile(r"\S+").findall


def check_window(max_words: int, overlap: int) -> None:
    for n, low, name in ((max_words, 1, "max_words"), (overlap, 0, "overlap")):
        if type(n) is not int or n < low:
            raise ValueError(f"{name} is a whole number from {low} on")
    if overlap >= max_words:
        raise ValueError("the overlap is smaller than the window")


def whole(records: DataFrame, text: str = "text") -> DataFrame:
    """One chunk a record."""
    index = F.lit(0)
    return records.select("doc_id", T.chunk_id(F.col("doc_id"), index).alias("chunk_id"), index.alias("chunk_index"), F.col(text).alias("text"))


def windows(records: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Sliding windows of words, max_words - overlap apart; the last one ends with the text. Texts without words: none."""
    check_window(max_words, overlap)
    stride = max_words - overlap
    w = records.select("doc_id", T.words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - max_words) / stride)).cast("int")
    cut = w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i * stride + 1, max_words), " "))).alias("chunk_index", "text"))
    return cut.select("doc_id", T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "text")


def pack_paragraphs(text: str, max_words: int, overlap: int) -> list[str]:
    """A text that fits is one piece. Else paragraphs are packed greedily; a piece after the first begins with the
    last words of the one before it, if the next paragraph still fits behind them. A paragraph that is too long by
    itself is cut into sliding windows, with no overlap to its neighbours."""
    check_window(max_words, overlap)
    text = text.strip()
    if len(_WORD(text)) <= max_words:
        return [text] if text else []
    out, open_, size = [], [], 0

    def close():
        if open_:
            out.append("\n\n".join(open_))

    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        w = _WORD(part)
        if len(w) > max_words:
            close()
            open_, size = [], 0
            for at in range(0, max(1, len(w) - overlap), max_words - overlap):
                out.append(" ".join(w[at : at + max_words]))
        elif open_ and size + len(w) > max_words:
            close()
            tail = _WORD(out[-1])[-overlap:] if overlap else []
            open_, size = [part], len(w)
            if tail and len(tail) + len(w) <= max_words:
                open_, size = [" ".join(tail), part], len(tail) + len(w)
        else:
            open_, size = [*open_, part], size + len(w)
    close()
    return out


def _exploded(cut):
    def run(it):
        for batch in it:
            ids, index, path, text = [], [], [], []
            for row in batch.to_pylist():
                for i, (p, piece) in enumerate(cut(row)):
                    ids.append(row["doc_id"]), index.append(i), path.append(p), text.append(piece)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(index, pa.int32()), pa.array(path, pa.string()), pa.array(text, pa.string())], names=["doc_id", "chunk_index", "section_path", "text"])

    return run


def _with_ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "section_path", "text")


def packed(records: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Paragraph-aware chunks of (doc_id, text)."""
    check_window(max_words, overlap)
    cut = _exploded(lambda row: [(None, p) for p in pack_paragraphs(row["text"] or "", max_words, overlap)])
    rows = records.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return _with_ids(rows.mapInArrow(cut, "doc_id string, chunk_index int, section_path string, text string"))


def sections(records: DataFrame, body: str = "body", title: str = "title") -> DataFrame:
    """(doc_id, section, title, section_path, content): Markdown parted at H1 and H2.

    The first H1 names the document and isn't part of any section; later H1 and H2 open sections and keep their line.
    Deeper headings stay inside. Sections without content are left out. title is used until an H1 is found."""
    rows = records.select("doc_id", F.col(title).alias("_title"), F.posexplode(T.lines(F.col(body))).alias("at", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    rows = rows.withColumns({"level": level, "name": T.strip(F.regexp_extract("line", HEADING, 2))})
    order = Window.partitionBy("doc_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h1", F.sum((F.col("level") == 1).cast("int")).over(upto))
    first = (F.col("level") == 1) & (F.col("h1") == 1)
    opens = F.col("level").between(1, 2) & ~first
    rows = rows.withColumns({"section": F.sum((first | opens).cast("int")).over(upto), "first": first, "opens": opens})
    doc_title = F.coalesce(F.max(F.when(F.col("first"), F.col("name"))).over(upto), T.strip(F.col("_title")))
    rows = rows.withColumn("doc_title", doc_title)
    keep = F.when(~F.col("first"), F.struct("at", "line"))
    out = rows.groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(keep)).alias("lines"), F.max(F.when(F.col("opens"), F.col("name"))).alias("own"), F.first("doc_title").alias("doc_title")
    )
    content = T.strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    out = out.withColumn("content", content).filter("content <> ''")
    return out.select("doc_id", "section", F.coalesce("own", "doc_title").alias("title"), F.concat_ws(" > ", "doc_title", "own").alias("section_path"), "doc_title", "content")


def markdown(records: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, body: str = "body", title: str = "title") -> DataFrame:
    """Chunks by section, each piece under its title, section and content labels, packed to max_words in all."""
    check_window(max_words, overlap)

    def pieces(row):
        out = []
        for s in sorted(row["sections"], key=lambda s: s["section"]):
            head = f"Title: {s['doc_title']}\n" + (f"Section: {s['title']}\n" if s["section_path"] != s["doc_title"] else "") + "Content:"
            room = max_words - len(_WORD(head))
            if room > 0:
                cut = [f"{head} {p}" for p in pack_paragraphs(s["content"], room, min(overlap, room - 1))]
            else:
                cut = pack_paragraphs(f"{head} {s['content']}", max_words, overlap)
            out += [(s["section_path"], p) for p in cut]
        return out

    parts = sections(records.withColumn("doc_id", F.col("doc_id").cast("string")), body, title)
    grouped = parts.groupBy("doc_id").agg(F.collect_list(F.struct("section", "title", "section_path", "doc_title", "content")).alias("sections"))
    return _with_ids(grouped.mapInArrow(_exploded(pieces), "doc_id string, chunk_index int, section_path string, text string"))
