import gzip
import hashlib
import zlib
from collections import Counter

import pytest

from kestrel.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, path string"  # clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def expected(rows, least=1000):
    keep = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            keep[h] = max(keep.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = keep.get(h) if i is not None else None
        to = None if to == i else to
        out[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to)] += 1
    return out


BIG = "é<p>" * 400
ROWS = [(1, "http://a/", BIG), (7, "http://b/\r\nX: y", BIG), (3, None, BIG), (7, "http://b/", BIG), (None, "u", BIG), (4, "u", None), (5, "u", ""), (6, "u", "same"),
        (8, "u", "same"), (-9, "u", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n"), (10, "u", "z" * 3_000_000), (11, "t\tab", "z" * 3_000_000)]


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(frame(spark, ROWS), folder=f"file://{tmp_path}/w", payloads=True).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(ROWS)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_many_revisits_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", BIG + str(i % 3)) for i in range(60)]
    got = warc.op10(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == expected(rows)


def test_empty(spark):
    assert warc.op10(frame(spark, [])).count() == 0


def test_index_points_at_members(spark, tmp_path):
    raw = warc.write(warc.with_references(frame(spark, ROWS)), str(tmp_path))
    made = warc.normalise(raw.checkpoint()).collect()
    n = 0
    for row in made:
        data = open(row["path"], "rb").read()
        lines = open(row["index"]).read().splitlines()
        assert len(lines) == row["n"]
        end = 0
        for line in lines:
            at, size = map(int, line.split("\t")[:2])
            assert at == end and gzip.decompress(data[at : at + size]).startswith(b"WARC/1.0\r\n")
            end = at + size
            n += 1
        assert end == len(data)
    assert n == len(ROWS)


def test_single_stream_and_members_inflate_alike(tmp_path):
    records = [warc.record(i, "u", b"x" * i, "d", None) for i in (1, 50, 5000)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("many", b"".join(gzip.compress(r) for r in records))):
        p = tmp_path / name
        p.write_bytes(data)
        with open(p, "rb") as f:
            assert [w for _, w in warc.split_records(warc.inflated(f))] == records
    p.write_bytes(data[:-20])
    with open(p, "rb") as f, pytest.raises((ValueError, zlib.error)):
        list(warc.split_records(warc.inflated(f)))


def test_a_changed_payload_is_noticed():
    whole = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(whole)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(whole.replace(b"payload\r", b"payloae\r"))


@pytest.mark.parametrize("i", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids(i):
    assert warc.page_of(warc.record_id(i)) == i
