import base64
import hashlib
import random

import pytest

from helpers import same_rows, write_tables
from emberspark.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", "<p>" + "aé\r\n\r\nWARC/1.1\r\n" * rng.randint(0, 3000)) for i in range(30)]
    rows += [(100 + i, None, "same page") for i in range(5)] + [(200, None, None), (201, None, ""), (None, None, "same page"),
             (None, None, "alone"), (300, None, "x" * 200000), (301, None, "x" * 200000)]
    return rows


def test_round_trip(spark):
    folder = write_tables(spark, pages=(pages(), SCHEMA))
    got = W.op6_warc(spark, folder)
    same_rows(got, W.SQL["op6_warc"], folder)
    for r in got.collect():
        if r.page_id is not None:
            raw = (next(h for p, _, h in pages() if p == r.page_id) or "").encode()
            assert r.payload_bytes == len(raw)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_segments_in_any_order_and_damage():
    payload = bytes(range(256)) * 300
    records = W.page_records(7, "p/1", payload, None, True, segment=1000)
    assert len(records) > 50
    parts = []
    for r in records:
        (fields, block), = W.parse_records(r + b"\r\n\r\n")
        parts.append((int(fields["warc-segment-number"]), int(fields["warc-segment-total-length"])
                      if "warc-segment-total-length" in fields else None, fields, block))
    random.Random(1).shuffle(parts)
    told = W.read_message(*W.reassemble(parts))
    assert told["intact"] and told["size"] == len(payload) and told["page"] == "p/1"
    assert W.reassemble(parts[1:]) is None
    assert W.reassemble([p for p in parts if p[1] is None]) is None
    fields, block = W.reassemble(parts)
    assert not W.read_message(fields, block.replace(b"\x10", b"\x11", 1))["intact"]


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 100000])
def test_chunked_framing(size):
    payload = random.Random(size).randbytes(size)
    assert W.dechunked(W.chunked(payload)) == payload
    with pytest.raises(ValueError):
        W.dechunked(W.chunked(payload)[:-6])


def test_least_payload_for_revisits_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    W.write_archives(df, f"{tmp_path}/a", least=10_000_000)
    assert {r.type for r in W.read_archives(spark, f"{tmp_path}/a").collect()} == {"response"}
    folder = write_tables(spark, pages=([], SCHEMA))
    assert W.op6_warc(spark, folder).count() == 0
