import base64
import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from apexframe.llm import warc as W

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    groups = defaultdict(list)
    for row_id, _, html in rows:
        groups[html or ""].append(row_id)
    out = []
    for row_id, url, html in rows:
        payload = (html or "").encode()
        known = [i for i in groups[html or ""] if i is not None]
        revisit = len(payload) >= least and known and len(groups[html or ""]) > 1 and row_id != max(known)
        out.append((row_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", max(known) if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://a/é x\r\ny", "<p>one</p>"), (3, "", None), (4, "http://b", ""), (5, "u", None), (None, "u", "<p>one</p>"),
    (None, None, "only nulls"), (None, None, "only nulls"), (6, "u", "é漢🦆" * 200_000), (7, "u", "é漢🦆" * 200_000), (8, "u", "same id"), (8, "u", "same id"), (8, "u", "other"),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (11, "u", "\r\n\r\n"), (12, "u", "\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("id", "payload", "sha", "n", "refers_to", "known", "archive")})


@pytest.mark.parametrize("least, roll", [(0, 1 << 30), (10, 500)])
def test_edge_rows(spark, least, roll):
    assert got(W.round_trip(frame(spark, ROWS), least=least, roll_bytes=roll)) == expected(ROWS, least)


def test_addresses_come_back(spark):
    uris = {r.page_id: r.uri for r in W.round_trip(frame(spark, ROWS[:4])).collect()}
    assert uris == {1: "http://a/1", 2: None, 9: "http://a/é%20x%0D%0Ay", 3: ""}


def test_empty_table(spark):
    assert W.round_trip(frame(spark, [])).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(W.round_trip(pages)) == expected(rows)


def test_every_record_is_a_member_at_its_offset(spark, tmp_path):
    streams, members = str(tmp_path / "streams"), str(tmp_path / "members")
    archives = W.write_archives(frame(spark, ROWS).repartition(2), streams, "page_id", "url", "html", roll_bytes=1000)
    index = W.normalise(archives, streams, members).collect()
    assert len(index) == len(ROWS) == sum(r.records for r in archives.collect())
    by_archive = defaultdict(list)
    for r in index:
        by_archive[r.archive].append(r)
    sidecar = set()
    for archive, rows in by_archive.items():
        data = (tmp_path / "members" / archive).read_bytes()
        rows.sort(key=lambda r: r.start)
        assert rows[0].start == 0 and all(a.start + a.bytes == b.start for a, b in zip(rows, rows[1:])) and rows[-1].start + rows[-1].bytes == len(data)
        for r in rows:
            unpacker = zlib.decompressobj(W.GZIP)
            assert unpacker.decompress(data[r.start : r.start + r.bytes]).startswith(b"WARC/1.1\r\n") and unpacker.eof and not unpacker.unused_data
        sidecar |= {line.split("\t")[0:4][0] + line.split("\t")[2] for line in (tmp_path / "members" / f"{archive}.cdx").read_text().splitlines()}
    assert sidecar == {f"{r.archive}{r.start}" for r in index}
    for name in (tmp_path / "streams").iterdir():  # the archives that were normalised were one stream each
        unpacker = zlib.decompressobj(W.GZIP)
        unpacker.decompress(name.read_bytes())
        assert unpacker.eof and not unpacker.unused_data


def test_streams_of_several_members_and_broken_ones():
    one, two = W.record(1, "u", b"first", None, False), W.record(2, "u", b"second" * 100_000, None, False)
    stream = W.Inflated(io.BytesIO(gzip.compress(one) + gzip.compress(two)))
    bodies = []
    while (head := stream.head()) is not None:
        bodies.append(b"".join(stream.body(int(W.fields(head)["content-length"]))))
    assert [b.partition(b"\r\n\r\n")[2] for b in bodies] == [b"first", b"second" * 100_000]
    with pytest.raises(ValueError):
        broken = W.Inflated(io.BytesIO(gzip.compress(one[:-20])))
        list(broken.body(int(W.fields(broken.head())["content-length"])))
    with pytest.raises(ValueError):
        W.fields(b"HTTP/1.1 200 OK")


@pytest.mark.parametrize("cut", ["at a record", "within a record", "no trailer", "half a trailer"])
def test_cut_off_streams_are_refused(cut):
    records = [W.record(i, "u", (b"%d " % i) * 2000, None, False) for i in range(3)]
    packer = zlib.compressobj(wbits=W.GZIP)
    parts = [packer.compress(r) + packer.flush(zlib.Z_SYNC_FLUSH) for r in records]
    whole = b"".join(parts) + packer.flush()
    data = {"at a record": b"".join(parts[:2]), "within a record": whole[: len(parts[0]) + 9], "no trailer": whole[:-8], "half a trailer": whole[:-3]}[cut]

    def read(data):
        stream, n = W.Inflated(io.BytesIO(data)), 0
        while (head := stream.head()) is not None:
            n += bool(b"".join(stream.body(int(W.fields(head)["content-length"]))))
        return n

    assert read(whole) == 3 and read(b"") == 0
    with pytest.raises(ValueError):
        read(data)


def test_missing_records_are_noticed(spark, tmp_path):
    streams = str(tmp_path / "streams")
    archives = W.write_archives(frame(spark, ROWS), streams, "page_id", "url", "html")
    more = archives.withColumn("records", archives.records + 1)
    with pytest.raises(ValueError, match="records in archives"):
        W.normalise(more, streams, str(tmp_path / "members"))
