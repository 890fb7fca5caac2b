import base64
import hashlib
import io
import zlib

import pytest

from sitegrain.llm import warc


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("packed", [True, False])
def test_an_intact_archive_is_read_once(packed):
    records = [warc.page_record(i, f"http://h/{i}", b"payload %d " % i * 30) for i in range(4000)]
    data = b"".join(map(warc.member, records)) if packed else b"".join(records)
    source = Counting(data)
    assert sum(r[0] == "record" for r in warc.salvage(source, len(data))) == 4000
    assert source.taken <= 2 * len(data)


def test_a_record_longer_than_the_window():
    big = bytes(range(256)) * 8000
    data = warc.member(warc.page_record(1, "u", big)) + warc.page_record(2, "u", big) + warc.member(warc.page_record(3, "u", b"end"))
    assert [warc.payload_of(r[3], r[4]) for r in read(data)] == [big, big, b"end"]


def test_fields_that_repeat():
    record = warc.record_bytes({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:x:1>", "WARC-Concurrent-To": "<urn:x:2>"}, b"x").replace(b"WARC-Concurrent-To: <urn:x:2>", b"WARC-Concurrent-To: <urn:x:2>\r\nWARC-Concurrent-To: <urn:x:3>")
    ((kind, _, _, headers, block),) = read(record)
    assert kind == "record" and headers["warc-concurrent-to"] == "<urn:x:2>" and headers.every["warc-concurrent-to"] == ["<urn:x:2>", "<urn:x:3>"] and block == b"x"
    twice = record.replace(b"WARC-Type: metadata", b"WARC-Type: metadata\r\nWARC-Type: response")
    assert [r[0] for r in read(twice)] == ["gap"]


def test_a_url_that_names_the_format():
    url = "http://h/WARC/1.1"
    assert read(warc.page_record(1, url, b"x"))[0][3]["warc-target-uri"] == url
    assert read(warc.member(warc.page_record(1, url + "/y", b"x")))[0][3]["warc-target-uri"] == url + "/y"


def test_blocks_without_an_http_header():
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "Content-Type": "text/dns"}
    block = b"20260101 a. IN A"
    ((_, _, _, found, held),) = read(warc.record_bytes(headers, block))
    assert warc.payload_of(found, held) == block and warc.payload_of(found, b"HTTP/1.1 204 No Content\r\n") == b""


@pytest.mark.parametrize("name", ["sha1", "sha256", "md5", "SHA-1"])
@pytest.mark.parametrize("field", ["WARC-Block-Digest", "WARC-Payload-Digest"])
def test_digests_of_every_kind(name, field):
    block = b"some block"
    digest = hashlib.new(name.lower().replace("-", ""), block).digest()
    for value in (digest.hex(), base64.b32encode(digest).decode()):
        headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", field: f"{name}:{value}"}
        assert [r[0] for r in read(warc.record_bytes(headers, block))] == ["record"]
        assert [r[0] for r in read(warc.record_bytes(headers, b"some blocK"))] == ["gap"]
    assert [r[0] for r in read(warc.record_bytes({**headers, field: "crc9:1"}, block))] == ["record"]


def test_salvage_of_damaged_tables(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * (i % 40)) for i in range(600)] + [(600, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.recovered) for r in warc.salvage_damaged(pages).collect()}
    assert got == {i: (len(f"page {i} " * (i % 40)) if i < 600 else 0, not warc.is_hurt(i)) for i in range(601)}
    assert 20 < sum(not ok for _, ok in got.values()) < 60
    assert warc.salvage_damaged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def pages_of(found):
    return [r[3]["x-page-id"] for r in found if r[0] == "record"]


@pytest.mark.parametrize("n", [2, 1000])
def test_members_of_several_records(n):
    records = [warc.page_record(i, "u", b"payload %d " % i * (i % 50)) for i in range(n)]
    data = warc.member(b"".join(records)) + warc.member(warc.page_record(n, "u", b"after"))
    found = read(data)
    assert pages_of(found) == [str(i) for i in range(n + 1)] and not any(r[0] == "gap" for r in found)
    assert {r[1:3] for r in found[:n]} == {(0, found[n][1])} and found[n][2] == len(data)


@pytest.mark.parametrize("n", [2, 1000])
def test_damage_inside_a_member_is_a_gap(n):
    records = [warc.page_record(i, "u", b"payload %d " % i * 20) for i in range(n)]
    for hurt in (1, 0, n - 1):
        for broken in (records[hurt][: len(records[hurt]) // 2], records[hurt].replace(b"payload", b"PAYLOAD"), b"noise"):
            found = read(warc.member(b"".join([*records[:hurt], broken, *records[hurt + 1 :]])))
            assert pages_of(found) == [str(i) for i in range(n) if i != hurt]
            assert [r[0] for r in found].count("gap") == 1


def test_a_large_member_that_is_cut_keeps_what_its_digests_vouch_for():
    records = [warc.page_record(i, "u", bytes((x * i) % 251 for x in range(4000))) for i in range(200)]
    whole = warc.member(b"".join(records))
    found = read(whole[: len(whole) // 2] + warc.member(warc.page_record(999, "u", b"x")))
    assert pages_of(found)[:50] == [str(i) for i in range(50)] and pages_of(found)[-1] == "999"
    assert [r[0] for r in found].count("gap") == 1
    again = read(whole[:-6] + b"abcdef")
    assert len(pages_of(again)) == 200 and again[-1][0] == "gap"


def test_a_member_larger_than_what_is_kept(monkeypatch):
    monkeypatch.setattr(warc, "_KEPT", 10_000)
    records = [warc.page_record(i, "u", b"payload %d " % i * 100) for i in range(300)]
    assert pages_of(read(warc.member(b"".join(records)) + warc.member(records[0]))) == [*map(str, range(300)), "0"]


def test_members_that_hold_no_record():
    data = warc.member(b"") + warc.member(b"no record") + warc.member(warc.page_record(1, "u", b"x"))
    assert [r[0] for r in read(data)] == ["gap", "record"]


def test_headers_of_members():
    import gzip

    out = io.BytesIO()
    with gzip.GzipFile("a name.warc", "wb", fileobj=out) as f:
        f.write(warc.page_record(1, "u", b"x") + warc.page_record(2, "u", b"y"))
    data = out.getvalue()
    assert pages_of(read(data)) == ["1", "2"] and pages_of(read(data[:-5] + b"12345")) == ["1", "2"]
    assert zlib.decompressobj(-15).decompress(data[warc._gzip_header(data) :]).startswith(b"WARC/1.1")
    extra = data[:3] + bytes([4 | 16 | 2]) + data[4:10] + b"\x03\0abc" + b"comment\0" + b"hh"
    assert warc._gzip_header(extra + b"rest") == len(extra)
