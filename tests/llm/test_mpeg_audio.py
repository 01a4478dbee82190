import hashlib
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from cinderfind.llm import mpeg_audio as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    media = M.encode(M.pad(data))
    s = M.read(media)
    assert M.payload_of(media, s) == M.pad(data) and not s.bad_crc and not s.skipped
    assert s.samples == len(M.pad(data)) and s.table["frames"] == len(s.offsets)


def test_resynchronises():
    payload = M.pad(bytes(range(256)) * 12)
    media = M.encode(payload)
    n = len(M.read(media).offsets)
    start = M.read(media).offsets[2]
    noise = b"\xff\xf2\xd8\xc0junk\xff\xff" * 3  # looks like headers
    broken = media[:start] + noise + media[start:]
    s = M.read(broken)
    assert len(s.offsets) == n and s.skipped == len(noise) and M.payload_of(broken, s) == payload
    s = M.read(media[:start] + media[start + 5 :])  # a frame has lost its head
    assert len(s.offsets) == n - 1
    bad = bytearray(media)
    bad[start + 8] ^= 1  # in the side information
    s = M.read(bytes(bad))
    assert s.bad_crc == 1 and len(s.offsets) == n - 1


def test_tags_and_tables():
    media = M.encode(M.pad(b"x" * 5000), "a title")
    s = M.read(media)
    assert s.tags == {"TIT2": "a title", "ID3v1": "a title"} and s.table["kind"] == "Xing" and len(s.table["seek"]) == 100
    assert s.table["bytes"] == int(s.sizes.sum()) + 648 and s.rate == 16000
    assert M.read(b"").samples == 0 and M.read(b"\xff" * 500).samples == 0
    with pytest.raises(ValueError):
        M.encode(b"x")


def test_crc():
    assert M.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def made(version, layer, kbps, rate, mono, body=b"", protected=False, n=4, joint=None):
    """n frames of a kind, with the body repeated, in plain Python from the standard's layout."""
    bits = {"1": 3, "2": 2, "2.5": 0}[version] << 3 | (4 - layer) << 1 | (not protected)
    index = M._KBPS[version == "1", layer].index(kbps) << 4 | [44100, 48000, 32000].index(rate * {"1": 1, "2": 2, "2.5": 4}[version]) << 2
    mode = 3 << 6 if mono else 0 if joint is None else 1 << 6 | joint << 4
    head = bytes([0xFF, 0xE0 | bits, index, mode])
    size = {1: 12000 * kbps // rate * 4, 2: 144000 * kbps // rate, 3: (144000 if version == "1" else 72000) * kbps // rate}[layer]
    return head, size, (head + body).ljust(size, b"\0") * n


@pytest.mark.parametrize("version, layer, kbps, rate, mono, samples", [("1", 3, 128, 44100, False, 1152), ("1", 3, 64, 48000, True, 1152), ("2", 3, 64, 22050, False, 576), ("2.5", 3, 8, 8000, True, 576), ("1", 2, 192, 44100, False, 1152), ("2", 2, 64, 24000, True, 1152), ("1", 1, 384, 48000, False, 384)])
def test_formats(version, layer, kbps, rate, mono, samples):
    _, size, data = made(version, layer, kbps, rate, mono)
    s = M.read(b"junk" + data)
    assert list(s.offsets) == [4 + i * size for i in range(4)] and (s.version, s.layer, s.rate, s.per_frame, s.skipped) == (version, layer, rate, samples, 4)
    assert s.duration_us == 4 * samples * 10**6 // rate


@pytest.mark.parametrize("version, layer, kbps, rate, mono, joint, covered", [
    ("1", 3, 128, 44100, False, None, 8 * 32), ("1", 3, 128, 44100, True, None, 8 * 17), ("1", 1, 384, 48000, False, None, 256), ("1", 1, 384, 48000, False, 0, 4 * (8 + 28)),
    ("1", 2, 192, 44100, False, None, 2 * (11 * 4 + 12 * 3 + 7 * 2) + 2 * 2), ("1", 2, 32, 32000, True, None, 2 * 4 + 10 * 3 + 2 * 2),
])
def test_checksums(version, layer, kbps, rate, mono, joint, covered):
    """The CRC of each layer covers just its bits: a flip within is noticed, one behind isn't."""
    body = bytes([0x11 if layer == 2 else 0]) + bytes(47)  # Layer II: two allocations that aren't 0
    head, size, _ = made(version, layer, kbps, rate, mono, protected=True, joint=joint)
    crc = M._crc_bits(M.crc16(head[2:]), body, covered)
    frame = (head + crc.to_bytes(2, "big") + body).ljust(size, b"\0")
    assert M.read(frame * 3).bad_crc == 0 and len(M.read(frame * 3).offsets) == 3
    for bit, bad in ((covered - 1, 1), (covered, 0)):
        at = size + 6 + bit // 8
        broken = bytearray(frame * 3)
        broken[at] ^= 128 >> bit % 8
        assert M.read(bytes(broken)).bad_crc == bad


def test_other_tags_and_tables():
    head, size, data = made("1", 3, 128, 44100, False)
    vbri = (head + bytes(32) + b"VBRI" + bytes(6) + (4 * size).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 2]) + bytes([1, 0, 2, 0])).ljust(size, b"\0")
    text = b"\x01" + "Tïtle".encode("utf-16")
    frame = b"TIT2" + bytes([0, 0, 1, 201 - 128]) + b"\0\0" + text.ljust(201, b"\0")  # a syncsafe size of 201
    tag = b"ID3\x04\0\x10" + bytes([0, 0, 1, len(frame) - 128]) + frame + b"3DI" + bytes(7)
    s = M.read(tag + vbri + data)
    assert s.tags == {"TIT2": "Tïtle"} and s.table == {"kind": "VBRI", "frames": 4, "bytes": 4 * size, "seek": [256, 512], "frames_per_entry": 2} and len(s.offsets) == 4
    old = b"ID3\x02\0\0" + bytes([0, 0, 0, 11]) + b"TT2" + bytes([0, 0, 5]) + b"\0abcd"
    stereo = (head + bytes(32) + b"Xing" + bytes([0, 0, 0, 1, 0, 0, 0, 4])).ljust(size, b"\0")
    s = M.read(old + stereo + data)
    assert s.tags == {"TT2": "abcd"} and s.table == {"kind": "Xing", "frames": 4} and not s.skipped


def test_column(spark, tmp_path):
    text = {1: "abc", 2: None, 3: "", 4: "é" * 700, None: "abc", 5: "long " * 200_000}
    rows = [(i, t, "m") for i, t in text.items()] + [(1, "abc", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = M.media_column(df).collect()
    assert len(stored) == 7 and M.media_column(df.limit(0)).count() == 0
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op6_mpeg_audio(spark, str(tmp_path)).collect()
    assert len(got) == 7
    media = {r.doc_id: bytes(r.media) for r in stored}
    for r in got:
        raw = M.pad((text[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text[r.doc_id] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-576:]))
        assert r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id]) and r.duration_us == len(raw) * 10**6 // 16000
        assert len(r.seek_offsets) == r.n_frames == len(raw) // 576 and all(media[r.doc_id][o] == 0xFF for o in r.seek_offsets)


def test_describe_any_audio(spark):
    _, size, data = made("1", 3, 128, 44100, False)
    df = spark.createDataFrame([("a", data, 1), ("b", None, 2), ("c", b"no audio", 3)], "name string, sound binary, rate int")
    got = {r.name: r for r in M.describe(df, "sound").collect()}
    assert got["a"].format == "MPEG-1 Layer 3" and got["a"].rate == 44100 and got["a"].seek_offsets == [i * size for i in range(4)] and got["a"].payload_bytes == 0
    assert [(got[n].n_frames, got[n].duration_us, got[n].format) for n in "bc"] == [(0, 0, None)] * 2


def test_tail_as_the_contract_has_it(spark, tmp_path):
    """tail_crc32 is of the last 32 payload bytes, whatever the padding."""
    texts = ["", None, "a" * 575, "a" * 576, "é" * 288, "b" * 577, "x" * 560 + "tail of the text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.tail_crc32 for r in M.op6_mpeg_audio(spark, str(tmp_path)).collect()}
    assert got == {i: zlib.crc32(M.pad((t or "").encode())[-32:]) for i, t in enumerate(texts)}
