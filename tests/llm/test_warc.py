import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cinderfind.llm import warc
from cinderfind.llm._common import Workspace


def brute(rows):
    by = {}
    for i, _, h in rows:
        if i is not None:
            by[h or ""] = max(by.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and i < by[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", by[h or ""] if again else None))
    return sorted(out, key=str)


def pages():
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nWARC-Target-URI: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://e/{i} x\r\ny", f"<p>{i}</p>" * (i * 13 % 200)) for i in range(120)]
    rows += [(200, "u", trap), (201, "u", "x" * 40 + trap * 30 + "WARC/1.1\r\n"), (202, None, None), (203, "u", ""), (204, "é", "é" * 3000), (205, "u", trap), (None, "u", trap), (206, "u", "<b>" * 9000)]
    rows += [(300 + i, "same", "copy") for i in range(40)] + [(300, "same", "copy")]
    return rows


def read(spark, rows, split):
    ws = Workspace(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hex string").repartition(3, F.col("url"))
    files = warc.write_archives(df, ws)
    return sorted((tuple(r)[:5] for r in warc.read_archives(ws, files, split).collect()), key=str)


def test_any_split_gives_the_same_records(spark):
    rows = pages()
    for split in (97, 4096, 1 << 20):
        assert read(spark, rows, split) == brute(rows)


def test_empty(spark):
    ws = Workspace(spark, "warc-test")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(ws, warc.write_archives(df, ws)).count() == 0


def test_header():
    data = warc.record(5, "http://a", b"body")
    fields, block, nxt = warc._header(data, 0)
    assert nxt == len(data) and fields[b"warc-record-id"] == b"<urn:x-page:5>"
    assert warc._header(b"WARC/1.1\r\nno header", 0) is None and warc._header(data[:20], 0) is None


def test_long_headers(spark):
    rows = pages()[:20] + [(400 + i, "http://long/" + "\n" * 40_000 + "x" * (i * 50_000), f"p{i}") for i in range(3)]
    assert read(spark, rows, 20_000) == brute(rows)


def test_lost_records_are_an_error(spark, tmp_path):
    ws = Workspace(spark, "warc-test")
    data = [warc.record(i, "u", b"x" * 50) for i in range(4)]
    for name, raw in (("whole", b"".join(data)), ("broken", data[0] + b"?" + data[1])):
        (tmp_path / name).write_bytes(raw)
        table = lambda n: spark.createDataFrame([(f"file://{tmp_path}/{name}", len(raw), n)], "file string, size long, n long")  # noqa: B023, E731
        if name == "whole":
            assert warc.read_archives(ws, table(4), 300).count() == 4
        with pytest.raises(ValueError):
            warc.read_archives(ws, table(5 if name == "whole" else 2), 300)
