"""Markdown, CSV and JSON sources as records: (id, semantic array<struct<label, value>>, structured JSON text, source).

Semantic fields alone are ever indexed; structured ones are scalars for filters. Markdown files are read whole, CSV and
JSON files as streams, and records ordered by path only where an order is asked for.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import math
import re
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfind.model import SourceError

RECORD = "id string, semantic array<struct<label:string,value:string>>, structured string, source string"
ID_NAMES = tuple("doc_id record_id document_id id".split())
SEMANTIC_NAMES = ("title", "name", "summary", "description", "question", "answer", "body", "content", "details", "notes", "resolution", "text")
_H1 = re.compile(r"[#][ \t]+(.+?)[ \t]*[#]*[ \t]*")


@lru_cache(4096)
def normalized(name):
    return "_".join(re.findall("[0-9a-z]+", name.lower()))


def _resolve(names: Sequence[str], wanted: str) -> str:
    same = [n for n in names if n == wanted] or [n for n in names if normalized(n) == normalized(wanted)]
    if len(same) != 1:
        raise SourceError(f"field {wanted!r} is {'not there' if not same else 'not unique'}")
    return same[0]


def id_field(names: Sequence[str], given: str | None = None) -> str:
    """The field that holds ids: the one given, a well-known name, or the first that ends in _id."""
    if given is not None:
        return _resolve(names, given)
    by = {}
    for n in names:
        by.setdefault(normalized(n), n)
    for known in ID_NAMES:
        if known in by:
            return by[known]
    for n in names:
        if normalized(n).endswith("_id"):
            return n
    raise SourceError("no field names a record's id")


def _scalar(value) -> bool:
    return isinstance(value, (str, bool, int)) or (isinstance(value, float) and math.isfinite(value))


def coerce(text: str):
    """CSV text as a truth value, a canonical whole number, a number with a point, or itself (007 is text)."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"-?(?:0|[1-9][0-9]*)", text):
        return int(text)
    if re.fullmatch(r"-?(?:[1-9]\d*|0)[.]\d+(?:[Ee][+-]?\d+)?", text) and math.isfinite(float(text)):
        return float(text)
    return text


def mapped(row: Mapping, source: str, id_name: str | None = None, semantic: Sequence[str] | Mapping[str, str] | None = None, structured: Sequence[str] | None = None, typed=lambda v: v) -> dict:
    """One source row as a record."""
    names = list(row)
    key = id_field(names, id_name)
    value = str(row[key] if row[key] is not None else "").strip()
    if not value:
        raise SourceError(f"{source}: a record's id is blank")
    if isinstance(semantic, Mapping):
        chosen = [(label, _resolve(names, n)) for label, n in semantic.items()]
    elif semantic is not None:
        chosen = [(f, f) for f in (_resolve(names, n) for n in semantic)]
    else:
        by = {normalized(n): n for n in reversed(names)}
        chosen = [(by[n], by[n]) for n in SEMANTIC_NAMES if n in by]
    fields = []
    for label, n in chosen:
        if isinstance(row[n], (list, dict)):
            raise SourceError(f"{source}: semantic field {n!r} is nested")
        if row[n] is not None and str(row[n]).strip():
            fields.append({"label": label, "value": str(row[n])})
    if not fields:
        raise SourceError(f"{source}: record {value!r} has no text")
    taken = {n for _, n in chosen}
    keep = {}
    for n in names if structured is None else [_resolve(names, s) for s in structured]:
        v = row[n]
        if v is None or v == "" or (structured is None and (n in taken or n == key)):
            continue
        v = typed(v) if isinstance(v, str) else v
        if not _scalar(v):
            if structured is not None:
                raise SourceError(f"{source}: structured field {n!r} is no scalar")
            continue
        keep[n] = v
    return {"id": value, "semantic": fields, "structured": json.dumps(keep, ensure_ascii=False), "source": source}


def parse_scalar(text: str):
    if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    low = text.lower()
    if low in ("~", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)", text) else text


def frontmatter(text: str) -> tuple[dict, str]:
    """(metadata, body): a leading block between two --- lines in a small subset of YAML (nested maps, lists of
    scalars, comments, quotes). Without a closed block, the whole text is body."""
    rows = text.splitlines()
    ends = [i for i, r in enumerate(rows) if r.strip() == "---"]
    if len(ends) < 2 or ends[0] != 0:
        return {}, text
    top: dict = {}
    open_: list[tuple[int, object]] = [(-1, top)]
    empty = None  # (indent, map, key) of a key whose value may follow
    for raw in rows[1 : ends[1]]:
        body = raw.strip()
        if not body or body[0] == "#":
            continue
        lead = raw[: len(raw) - len(raw.lstrip())]
        if "\t" in lead:
            raise SourceError("frontmatter is indented by blanks, not tabs")
        while len(open_) > 1 and len(lead) <= open_[-1][0]:
            open_.pop()
        if empty and len(lead) > empty[0]:
            inner = [] if body.startswith("- ") else {}
            empty[1][empty[2]] = inner
            open_.append((empty[0], inner))
            empty = None
        here = open_[-1][1]
        if body.startswith("- "):
            if not isinstance(here, list):
                raise SourceError("a list item stands outside a list in frontmatter")
            here.append(parse_scalar(body[2:].strip()))
            continue
        name, colon, value = (x.strip() for x in body.partition(":"))
        if not colon or not name:
            raise SourceError(f"frontmatter has a line that is no field: {body!r}")
        if isinstance(here, list):
            raise SourceError("a field stands inside a list in frontmatter")
        here[name] = parse_scalar(value) if value else {}
        empty = None if value else (len(lead), here, name)
    return top, "\n".join(rows[ends[1] + 1 :]).strip()


def markdown_record(text: str, source: str, stem: str, id_name: str = "doc_id", title_name: str = "title") -> dict:
    meta, body = frontmatter(text)
    rows = body.splitlines()
    heading = next((m[1].strip() for m in map(_H1.fullmatch, rows) if m), None)
    first = next((i for i, r in enumerate(rows) if r.strip()), None)
    if first is not None and _H1.fullmatch(rows[first]):
        body = "\n".join(rows[:first] + rows[first + 1 :]).strip()
    out = {}
    for name, otherwise in ((id_name, stem), (title_name, heading or stem)):
        value = str(meta[name] if meta.get(name) is not None else "").strip() if name in meta else otherwise
        if not value:
            raise SourceError(f"{source}: {name} is blank")
        out[name] = value
    keep = {k: v for k, v in meta.items() if _scalar(v)} | out
    fields = [{"label": "Title", "value": out[title_name]}] + ([{"label": "Body", "value": body}] if body.strip() else [])
    return {"id": out[id_name], "semantic": fields, "structured": json.dumps(keep, ensure_ascii=False), "source": source}


def csv_rows(lines: Iterable[str], source: str, delimiter: str = ",", **options) -> Iterator[dict]:
    """Records of a CSV's lines, which keep their ends, one at a time and of any length."""
    csv.field_size_limit(sys.maxsize)
    lines = iter(lines)
    rows = csv.reader(itertools.chain([next(lines, "").removeprefix("\ufeff")], lines), delimiter=delimiter)
    header = [h.strip() for h in next(rows, [])]
    if not any(header) or len(set(header)) < len(header) or not all(header):
        raise SourceError(f"{source}: a header of unique names is needed")
    for n, row in enumerate(rows, 2):
        if not row:
            continue
        if len(row) > len(header):
            raise SourceError(f"{source}: row {n} has more values than the header")
        yield mapped(dict(zip(header, row + [""] * (len(header) - len(row)))), source, typed=coerce, **options)


def csv_records(text: str, source: str, delimiter: str = ",", **options) -> list[dict]:
    return list(csv_rows(io.StringIO(text, newline=""), source, delimiter, **options))


class _Json:
    """Values of a JSON text one after another, of which a block and the value at hand are held."""

    SLACK = 64  # an error so near to the end of what is held may come of what isn't there yet

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.held, self.at, self.ended = stream, block, "", 0, False
        self.decoder = json.JSONDecoder()

    def more(self) -> None:
        got = self.stream.read(max(self.block, len(self.held) - self.at))  # a long value is read in ever longer parts
        self.held, self.at, self.ended = self.held[self.at :] + got, 0, not got

    def peek(self) -> str:
        """The next character that isn't blank; none at the end."""
        while True:
            self.at = _BLANK.match(self.held, self.at).end()
            if self.at < len(self.held) or self.ended:
                return self.held[self.at : self.at + 1]
            self.more()

    def take(self, wanted: str) -> str:
        if (c := self.peek()) == "" or c not in wanted:
            raise ValueError(f"one of {wanted} is missing")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.held, self.at)
            except json.JSONDecodeError as e:
                if self.ended or not e.msg.startswith("Unterminated string") and len(self.held) - e.pos > self.SLACK:
                    raise
            else:
                if end < len(self.held) or self.ended:  # else a number may go on
                    self.at = end
                    return found
            self.more()

    def items(self):
        """The values of the list that begins here."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return


def _json_values(stream, records_key: str, block: int) -> Iterator:
    text = _Json(stream, block)
    if text.peek() == "[":
        yield from text.items()
    elif text.peek() == "{":
        text.take("{")
        fields, several = {}, False
        while text.peek() != "}":
            if text.peek() != '"':
                raise ValueError("a name is missing")
            name = text.value()
            text.take(":")
            if name == records_key and (several or text.peek() == "["):
                if several or name in fields:
                    raise ValueError(f"{records_key} comes twice")
                several = True
                fields.clear()
                yield from text.items()
            elif several:
                text.value()
            else:
                fields[name] = text.value()
            if text.take(",}") == "}":
                break
            if text.peek() != '"':
                raise ValueError("a name is missing")
        else:
            text.take("}")
        if not several:
            yield fields
    else:
        yield text.value()
    if text.peek():
        raise ValueError("more follows")


def json_rows(stream, source: str, by_line: bool, records_key: str = "records", block: int = 1 << 20, **options) -> Iterator[dict]:
    """Records of a text stream, one at a time: of a list, of the list at records_key, the object itself, or one a line."""
    try:
        for row in (json.loads(r) for r in stream if r.strip()) if by_line else _json_values(stream, records_key, block):
            if not isinstance(row, dict):
                raise SourceError(f"{source}: a record is no object")
            yield mapped(row, source, **options)
    except SourceError:
        raise
    except UnicodeDecodeError:
        raise
    except ValueError as e:
        raise SourceError(f"{source}: no JSON: {e}") from e


def json_records(text: str, source: str, by_line: bool, records_key: str = "records", **options) -> list[dict]:
    return list(json_rows(io.StringIO(text, newline=None), source, by_line, records_key, **options))


_EXTENSIONS = {"markdown": ("md", "markdown"), "csv": ("csv",), "json": ("json", "jsonl", "ndjson")}


def _filesystem(uri: str, path: str):
    """(Arrow's file system, path there) of a place."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if uri.startswith("file:") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _listed(uri: str, path: str, deep: bool):
    """Folders (name below a root, true) -> their files (name, false), or without deep what stands right in them."""

    def run(it):
        from pyarrow import fs

        files, base = _filesystem(uri, path)
        for batch in it:
            for row in batch.to_pylist():
                if not row["folder"]:
                    found = [row]
                else:
                    infos = files.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{row['name']}", recursive=deep))
                    found = [{"name": i.path[len(base) :].lstrip("/"), "folder": i.type == fs.FileType.Directory} for i in infos]
                    found = [f for f in found if not any(_HIDDEN.match(p) for p in f["name"].split("/")) and not (deep and f["folder"])]
                for start in range(0, len(found), 10_000):
                    part = found[start : start + 10_000]
                    yield pa.record_batch([pa.array([f["name"] for f in part], pa.string()), pa.array([f["folder"] for f in part], pa.bool_())], names=["name", "folder"])

    return run


def read(spark: SparkSession, path: str, kind: str, encoding: str = "utf-8", **options) -> DataFrame:
    """Records of a file, or of all files of the kind below a folder. kind: markdown, csv or json.

    source is the path below the folder, or the path itself for a file. A folder without such files is an error.
    Options: id_name, semantic, structured; title_name (markdown), delimiter (csv), records_key (json).

    The folders below the root are listed by tasks, and their files dealt out evenly. CSV and JSON files are read as
    streams: a task holds a block of a file and BYTES of records, however long the file is. One file is one task's.
    """
    endings = _EXTENSIONS[kind]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise SourceError(f"{path} does not exist")
    status = fs.getFileStatus(hadoop)
    uri, root = status.getPath().toUri().toString(), status.getPath().toUri().getPath()
    folder = status.isDirectory()
    if not folder and not path.lower().endswith(tuple("." + e for e in endings)):
        raise SourceError(f"{path} doesn't end in {' or '.join(endings)}")
    wanted = endings[:1] if folder and kind == "markdown" else endings
    files = spark.createDataFrame([("", folder)], "name string, folder boolean").coalesce(1)
    if folder:
        parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        files = files.mapInArrow(_listed(uri, root, False), files.schema).repartition(parts).mapInArrow(_listed(uri, root, True), files.schema)
        files = files.filter(F.lower("name").rlike(r"\.(" + "|".join(wanted) + ")$"))
        if files.isEmpty():
            raise SourceError(f"no {kind} files below {path}")
        files = files.repartition(parts)

    def records(stream, name: str):
        source = name if folder else path
        if kind == "csv":
            yield from csv_rows(io.TextIOWrapper(stream, encoding, newline=""), source, **options)
        elif kind == "json":
            yield from json_rows(io.TextIOWrapper(stream, encoding, newline=None), source, not source.lower().endswith(".json"), **options)
        else:
            text = stream.read().decode(encoding).replace("\r\n", "\n")
            yield markdown_record(text, source, source.rpartition("/")[2].rpartition(".")[0], **options)

    def run(it):
        held, size = [], 0
        store, base = _filesystem(uri, root)
        for batch in it:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{base.rstrip('/')}/{name}" if folder else base) as raw:
                    try:
                        for record in records(io.BufferedReader(raw, 1 << 20) if kind != "markdown" else raw, name):
                            held.append(record)
                            size += 200 + len(record["structured"]) + sum(len(f["value"]) for f in record["semantic"])
                            if size > BYTES:
                                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                                held, size = [], 0
                    except UnicodeDecodeError as e:
                        raise SourceError(f"{name if folder else path}: not {encoding}") from e
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return files.mapInArrow(run, RECORD)


BYTES = 4 << 20  # of records that a task hands on at once, single ones aside
_HIDDEN = re.compile(r"\.|_(?!.*=)")  # as Spark leaves out
_BLANK = re.compile(r"[ \t\n\r]*")
_ARROW = pa.schema([("id", pa.string()), ("semantic", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), ("structured", pa.string()), ("source", pa.string())])
