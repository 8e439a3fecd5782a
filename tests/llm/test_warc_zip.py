import hashlib
import io
import struct
import zipfile

import pytest

from scanloom.llm import warc_zip as W


def rows():
    same = "<p>" + "x" * 200 + "</p>"
    return [(4, "http://a/", same), (2, "http://b/\r\nX: y", same), (9, None, same), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", same), (2, "http://b2/", same), (11, "u", "é" * 50), (10, "u", "é" * 50), (12, "u", "WARC/1.1\r\n\r\n" * 20), (13, "u", "y" * 400_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, __raw string").repartition(3)
    got = W.round_trip(df).collect()
    assert len(got) == len(rows())
    payloads = {}
    for page, _, html in rows():
        payloads.setdefault(page, set()).add(html or "")
    for r in got:
        assert r.payload_digest in {hashlib.sha256(p.encode()).hexdigest() for p in payloads[r.page_id]}
    same = [r for r in got if r.payload_bytes == 207]
    assert [(r.page_id, r.refers_to) for r in same if r.record_type == "response"] == [(2, None)]
    assert sorted((r.page_id or 0, r.refers_to) for r in same if r.record_type == "revisit") == [(0, 2), (2, 2), (4, 2), (9, 2)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (10, 11)} == {(10, "response", None), (11, "revisit", 10)}
    assert all(r.record_type == "response" for r in got if r.page_id in (5, 6, 7, 8, 12, 13))
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload).decode() in payloads[r.page_id]


def test_empty_and_small_packages(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    assert W.round_trip(df.limit(0)).collect() == []
    packages = W.write(df.coalesce(1), f"file://{tmp_path}/w")
    assert packages.agg({"records": "sum"}).first()[0] == len(rows())
    for r in packages.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:  # any reader can open them
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64_directory():
    data, name, size64 = b"hello", b"big.bin", 0xFFFFFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, size64, size64, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + data
    pad = b"\0" * 100
    extra = struct.pack("<HHI", 0x7777, 4, 1) + struct.pack("<HHQQQ", 1, 24, 5, 5, len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, size64, size64, len(name), len(extra), 3, 0, 0, 0, size64) + name + extra + b"abc"
    at = len(pad) + len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, size64, size64, 4) + b"note"
    raw = pad + local + central + end64 + locator + end
    package = W.Package(io.BytesIO(raw), len(raw))
    place, size = package.place("big.bin")
    assert package.read(place, size) == data
    with pytest.raises(ValueError):
        W.Package(io.BytesIO(b"nothing"), 7)


def test_compressed_members_are_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 1000)
    with pytest.raises(ValueError):
        W.Package(buffer, len(buffer.getvalue())).place("a")
