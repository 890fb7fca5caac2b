import io

import pytest

from sitegrain.llm import warc

URL = "data:text/html," + "é0" * 50_000


@pytest.mark.parametrize("length", [10, 65_000, 65_536, 131_072, len(URL)])
@pytest.mark.parametrize("packed", [True, False])
def test_header_blocks_of_any_length(length, packed):
    records = [warc.page_record(i, URL[:length] if i == 1 else "u", b"payload %d " % i * 20) for i in range(3)]
    data = b"".join(map(warc.member, records)) if packed else b"".join(records)
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [r[0] for r in found] == ["record"] * 3 and found[1][3]["warc-target-uri"] == URL[:length]


def test_header_without_end_is_a_gap():
    good = warc.page_record(1, "u", b"x" * 200)
    data = b"WARC/1.1\r\nA: " + b"a" * 300_000 + good + b"WARC/1.1\r\nB: " + b"b" * 300_000
    assert [r[0] for r in warc.salvage(io.BytesIO(data), len(data))] == ["gap", "record", "gap"]


def test_round_trip_of_a_long_url(spark):
    pages = spark.createDataFrame([(1, URL[:100_000], "x" * 200), (2, "u", "y")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(pages).collect()) == [(1, 200), (2, 1)]
    archives = warc.write_archives(pages)
    assert {r.uri for r in warc.read_archives(archives).collect()} == {URL[:100_000], "u"}
