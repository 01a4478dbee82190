"""WARC archives: a writer, and a reader that finds records by verifying the chain of their boundaries.

Reading a large uncompressed archive in parallel means starting in its middle, where a payload may hold the record
magic. So tasks read splits and emit every place with the magic and a parsable header as a candidate, with the place
where the chain that starts there leaves the split. Pointer jumping from the files' starts over these pointers keeps
the candidates where the true chain enters each split: a magic inside a payload is never reached. A second pass walks
each split from its true entry alone.

Archives are files in the cluster's shared folder, written under the attempt's name and listed in a table that only
finished tasks reach; a repeated task leaves an unlisted file behind, no double record.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfind.llm._common import Workspace

MAGIC = b"WARC/1.1\r\n"
SPLIT = 8 << 20
HEADER = 64 << 10  # read beyond a split at first; a longer header block is read on
_PART = re.compile(rb"(?:[!-9;-~]+(?::[^\r\n]*)?)?\r?\Z")  # what may stand at the end of cut data
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, digest: str | None = None, length: int | None = None) -> bytes:
    """A response record, or where refers_to is given a revisit record of the identical-payload-digest profile,
    which keeps the HTTP header (and so the payload's length) but no payload."""
    digest = digest or base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank").encode()
    head = [
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:x-page:%s>" % str("null" if page_id is None else page_id).encode(),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Target-URI: " + uri,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    if refers_to is not None:
        payload = b""
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:x-page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(http) + len(payload))]
    return MAGIC + b"\r\n".join(head) + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _cut(data: bytes, at: int) -> bool:
    """Whether the header that seems to begin at a place is cut off by the end of the data."""
    if not data.startswith(MAGIC, at):
        return len(data) - at < len(MAGIC) and MAGIC.startswith(data[at:])
    p = at + len(MAGIC)
    while m := _FIELD.match(data, p):
        p = m.end()
    return _PART.match(data, p) is not None


def _header(data: bytes, at: int) -> tuple[dict, int, int] | None:
    """(fields, where the block begins, where the next record begins) of the record header at a place, if it is one."""
    if not data.startswith(MAGIC, at):
        return None
    p, fields = at + len(MAGIC), {}
    while not data.startswith(b"\r\n", p):
        m = _FIELD.match(data, p)
        if not m:
            return None
        fields[m[1].lower()] = m[2]
        p = m.end()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in fields or b"warc-record-id" not in fields:
        return None
    return fields, p + 2, p + 2 + int(size) + 4


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(root: str):
    def run(it):
        task = TaskContext.get()
        name, size, n, out = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc", 0, 0, None
        for batch in it:
            for row in batch.to_pylist():
                if out is None:
                    files, at = _fs(name)
                    files.create_dir(at.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(at)
                data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], base64.b32encode(bytes.fromhex(row["hex"])).decode(), row["length"])
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "size", "n"])

    return run


def write_archives(pages: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """Writes (page_id, url, html) to archives and returns the table of their files (file, size, n).

    Of pages whose equal payload has min_bytes at least, the largest page_id has a response record and others revisit
    it. Payloads are told apart by SHA-256 in an aggregation that combines map-side; only shared ones are joined.
    A page without an id neither answers nor revisits for others.
    """
    keyed = pages.select("page_id", "url", "html", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keyed = keyed.select("page_id", "url", "html", F.sha2("payload", 256).alias("key"), F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("hex"))
    thin = keyed.filter((F.col("length") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # as a table its size is known: a small one is broadcast below spark.sql.autoBroadcastJoinThreshold, and then no
    # payload is shuffled; a larger one is joined by key
    shared = ws.save(thin.filter("n > 1").select(F.col("key").alias("k"), "first"), "shared")
    joined = keyed.join(shared, (F.col("key") == F.col("k")) & (F.col("page_id") < F.col("first")), "left")
    rows = joined.select(
        "page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), F.col("first").alias("refers_to"), "hex", "length"
    )
    return ws.save(rows.mapInArrow(_write(ws.path("warc")), "file string, size long, n long"), "files")


def _read(file: str, start: int, end: int) -> bytes:
    files, at = _fs(file)
    with files.open_input_file(at) as f:
        return f.read_at(end - start, start)


def _read_on(file: str, base: int, data: bytes, at: int, last: int) -> bytes:
    """The data from base on, with as much more as the header at a place needs."""
    while _cut(data, at) and base + len(data) < last:
        more = max(HEADER, len(data) - at)
        data += _read(file, base + len(data), min(base + len(data) + more, last))
    return data


def _candidates(it):
    """(file, size, start, end) -> (file, at, to, n): each candidate of a split, where its chain leaves the split, and
    after how many records.

    A chain that breaks (its next place has no header) ends in -1: nothing true lies behind it."""
    for batch in it:
        for row in batch.to_pylist():
            base, end, last = row["start"], row["end"], row["size"]
            data = _read(row["file"], base, min(end + HEADER, last))
            places, p = [], data.find(MAGIC)
            while 0 <= p < end - base:
                places.append(p)
                p = data.find(MAGIC, p + 1)
            to: dict[int, int] = {}
            n: dict[int, int] = {}
            for p in reversed(places):
                data = _read_on(row["file"], base, data, p, last)
                if head := _header(data, p):
                    n[p] = 1 + n.get(head[2], 0)
                    nxt = head[2] + base
                    to[p] = nxt if nxt >= end else to.get(nxt - base, -1)
                    if nxt > last:
                        to[p] = -1
            yield pa.record_batch([pa.array([row["file"]] * len(to), pa.string()), pa.array([p + base for p in to], pa.int64()), pa.array(list(to.values()), pa.int64()), pa.array([n[p] for p in to], pa.int64())], names=["file", "at", "to", "n"])


def entries(ws: Workspace, splits: DataFrame) -> DataFrame:
    """(file, at): where the true chain enters each split, by pointer jumping over the candidates' pointers.

    A file whose chain from 0 does not end where the file does, or has another number of records than its n (where
    splits have one), is an error."""
    there = ws.save(splits.mapInArrow(_candidates, "file string, at long, to long, n long").filter("to >= 0"), "candidates")
    places = there.select("file", "at").hint("merge")
    reached = places.filter("at = 0")
    # only a candidate that another split's chain leads to can be an entry
    jumps = there.join(there.select("file", F.col("to").alias("at")).distinct().union(reached).hint("merge"), ["file", "at"], "left_semi")
    jumps, step = ws.save(jumps, "jump-0"), 0
    while True:
        found = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")).join(places, ["file", "at"], "left_semi")
        reached = ws.save(reached.union(found).distinct(), f"reached-{step + 1}")
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        further = ws.save(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("far").alias("to")), f"jump-{step + 1}")
        ws.drop(f"jump-{step}"), ws.drop(f"reached-{step}")
        jumps, step = further, step + 1
        if jumps.isEmpty():
            _whole(splits, there, reached)
            return reached


def _whole(splits: DataFrame, there: DataFrame, reached: DataFrame) -> None:
    walked = there.join(reached, ["file", "at"]).groupBy("file").agg(F.max("to").alias("to"), F.sum("n").alias("found"))
    said = F.col("n") if "n" in splits.columns else F.lit(None).cast("long")
    files = splits.select("file", "size", said.alias("n")).distinct().join(walked, "file", "left")
    bad = files.filter(F.col("to").isNull() | (F.col("to") != F.col("size")) | (F.coalesce("n", "found") != F.col("found"))).first()
    if bad:
        raise ValueError(f"{bad.file}: its records reach to {bad.to} of {bad['size']} bytes; {bad.found} were found, {bad.n} written")


def _records(it):
    """(file, size, at, end) -> the records of a split, from its true entry on."""
    number = lambda value: int(m[1]) if (m := re.search(rb"page:(-?\d+)", value)) else None
    for batch in it:
        for row in batch.to_pylist():
            base, p, out, held = row["at"], 0, [], 0
            data = _read(row["file"], base, min(row["end"] + HEADER, row["size"]))
            while base + p < row["end"]:
                data = _read_on(row["file"], base, data, p, row["size"])
                head = _header(data, p)
                if head is None:
                    raise ValueError(f"{row['file']} at {base + p}: no record begins here")
                fields, block, nxt = head
                if nxt > len(data):  # the last record of the split
                    data = _read(row["file"], base, min(base + nxt, row["size"]))
                http, _, payload = data[block : nxt - 4].partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                kind = fields[b"warc-type"].decode()
                digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{row['file']} at {base + p}: the payload is not what its digest says")
                out.append((number(fields[b"warc-record-id"]), size, digest, kind, number(fields.get(b"warc-refers-to", b"")), fields[b"warc-target-uri"].decode(), payload.decode() if kind == "response" else None))
                p, held = nxt, held + len(payload)
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def _rows(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in READ.split(", ")])


def read_archives(ws: Workspace, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives listed as (file, size) or (file, size, n), n the records that are there: one row each,
    with the payload of responses."""
    splits = files.filter("size > 0").select("file", "size", *[c for c in files.columns if c == "n"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split, F.col("size")))
    spread = max(1, min(10_000, splits.count()))
    splits = splits.repartition(spread, "file", "start")
    true = entries(ws, splits).withColumn("start", (F.floor(F.col("at") / split) * split).cast("long"))
    return splits.join(true, ["file", "start"]).select("file", "size", "at", "end").repartition(spread, "file", "at").mapInArrow(_records, READ)


def op8_warc(spark, sf_dir):
    ws = Workspace(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), ws)
    return read_archives(ws, files).drop("url", "html")
