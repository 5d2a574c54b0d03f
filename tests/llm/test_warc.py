import base64
import gzip
import hashlib
import zlib

import pytest

from kinetable.llm import warc as W


def record(k, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{W.PAGE}{k}>\r\nWARC-Payload-Digest: {W._digest(payload)}\r\nWARC-Block-Digest: {W._digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


RECORDS = [record(k, f"<p>page {k} \r\n\r\nWARC/1.1 é</p>".encode() * (k + 1)) for k in range(6)]


def read(data):
    found = list(W.salvage(data))
    return [W._page(x.headers["warc-record-id"]) for x in found if isinstance(x, W.Record)], [x for x in found if isinstance(x, tuple)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [gzip.compress(r) for r in RECORDS] if packed else RECORDS
    whole = b"".join(parts)
    assert read(whole) == ([0, 1, 2, 3, 4, 5], [])
    start = sum(map(len, parts[:2]))
    broken = bytearray(whole)
    broken[start + len(parts[2]) // 2] ^= 0xFF
    ids, gaps = read(bytes(broken))
    assert ids == [0, 1, 3, 4, 5] and [(g[0], g[1]) for g in gaps] == [(start, len(parts[2]))]
    ids, gaps = read(b"garbage" + whole[: start - 5])
    assert ids == [0] and [(g[0], g[1]) for g in gaps] == [(0, 7), (7 + len(parts[0]), len(parts[1]) - 5)]
    ids, gaps = read(whole[:start] + whole[start + 20 :])
    assert ids == [0, 1, 3, 4, 5] and len(gaps) == 1
    assert read(b"") == ([], []) and read(b"\x00" * 100) == ([], [(0, 100, "version line")])


def test_members_with_several_records_and_wrong_lengths():
    assert read(gzip.compress(RECORDS[0] + RECORDS[1]) + RECORDS[2]) == ([0, 1, 2], [])
    wrong = RECORDS[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    ids, gaps = read(RECORDS[0] + wrong + RECORDS[2])
    assert ids == [0, 2] and gaps[0][:2] == (len(RECORDS[0]), len(wrong))


def test_members_with_damaged_records():
    wrong = RECORDS[2].replace(b"page 2", b"page X", 1)
    whole = b"".join([*RECORDS[:2], wrong, *RECORDS[3:]])
    packed = gzip.compress(whole)
    start = len(RECORDS[0] + RECORDS[1])
    ids, gaps = read(RECORDS[0] + packed + RECORDS[1])
    assert ids == [0, 0, 1, 3, 4, 5, 1]
    assert gaps == [(len(RECORDS[0]), len(packed), f"block digest: bytes {start} to {start + len(wrong)} of the member's content")]
    ids, gaps = read(gzip.compress(b"".join(RECORDS[:2]) + b"junk"))
    assert ids == [0, 1] and "version line" in gaps[0][2]


@pytest.mark.parametrize("level", [0, 9])
def test_damaged_members_keep_what_was_unpacked(level):
    noise = [record(k, base64.b64encode(hashlib.sha512(b"%d" % k).digest() * 20)) for k in range(8)]
    packed = gzip.compress(b"".join(noise), level)
    crc = bytearray(packed)
    crc[-6] ^= 1
    assert read(bytes(crc) + RECORDS[1])[0] == [*range(8), 1]
    ids, gaps = read(packed[: len(packed) * 3 // 4])
    assert ids and ids == list(range(len(ids))) and len(ids) < 8 and gaps
    ids, gaps = read(packed[: len(packed) * 3 // 4] + gzip.compress(RECORDS[5]) + RECORDS[4])
    assert ids[-2:] == [5, 4] and ids[:-2] == list(range(len(ids) - 2)) and len(ids) > 2 and gaps


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a/x y\r\n", "<p>same é</p>"), (3, None, "<p>same é</p>"), (9, "u", "<p>same é</p>"), (1, "u", None), (2, "u", ""), (4, "u", "WARC/1.1\r\n\r\n\r\n\r\nx" * 3),
        (7, "u", "\r\n\r\n"), (8, "u", "é🙂" * 100_000), (3, None, "<p>same é</p>"), (None, "u", "<p>same é</p>"), (None, "u", "lone"), (None, "u", "lone"),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, first string").repartition(3)
    folder = str(tmp_path / "archives")
    W.write_archives(pages, folder)
    got = W.read_archives(spark, folder).collect()
    assert {r.kind for r in got} == {"record"}
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    want = []
    for i, _, t in rows:
        data, first = (t or "").encode(), least.get(t or "")
        revisit = first is not None and i != first
        want.append((str(i), len(data), b32(data), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    have = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_gaps_are_logged_and_small_payloads_are_stored(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aaaa"), (2, "u", "aaaa"), (3, "u", "bbbbbbbbbb"), (4, "u", "bbbbbbbbbb")], "page_id long, url string, html string").coalesce(1)
    W.write_archives(pages, str(tmp_path / "a"), least=5)
    kinds = {r.page_id: r.record_type for r in W.read_archives(spark, str(tmp_path / "a")).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(RECORDS[0] + b"junk" + RECORDS[1])
    got = sorted((r.kind, r.offset, r.length, r.reason, r.page_id) for r in W.read_archives(spark, str(tmp_path / "b")).collect() if r.kind == "gap")
    assert got == [("gap", len(RECORDS[0]), 4, "version line", None)]
    W.write_archives(pages.limit(0), str(tmp_path / "c"))
    assert W.read_archives(spark, str(tmp_path / "c")).count() == 0


def test_damaged_member_is_told_by_zlib():
    data = bytearray(gzip.compress(RECORDS[0]))
    data[-6] ^= 1  # the checksum
    with pytest.raises(zlib.error):
        zlib.decompressobj(31).decompress(bytes(data))
    assert read(bytes(data) + RECORDS[1])[0] == [1]
