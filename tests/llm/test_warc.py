import hashlib
import random

from loomgraph.llm.warc import op6_warc, pack, parse_record, read_archives, unpack, warc_record, write_archives
from loomgraph.session import new_path

DATE = "2024-01-02T03:04:05Z"


def test_archive_round_trip():
    rng = random.Random(1)
    words = ["<p>", "</p>", "alpha", "beta", "gamma", "<div class='x'>"]
    records = [warc_record("response", i, f"http://a/{i}", "d", 5, " ".join(rng.choices(words, k=300)).encode(), DATE) for i in range(200)]
    for some in (records, records[:2], []):
        assert list(unpack(pack(some))) == some
    data = pack(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert int.from_bytes(data[4:8], "little") > 0
    assert len(data) < sum(map(len, records)) // 3
    fields, body = parse_record(records[3])
    assert fields["WARC-Target-URI"] == "http://a/3" and len(body) > 100
    assert records[3].startswith(b"WARC/1.1\r\n") and fields["WARC-Date"] == DATE and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in records[3]


def test_pages(spark):
    big = "é" * 9_000_000
    rows = [(1, "u", "x" * 100, 0), (2, "v\r\nX: y", "x" * 100, 0), (3, "w", "short", 0), (4, None, "short", 0), (5, "a", None, 0), (None, "n", "x" * 100, 0), (6, "b", big, 0), (7, "c", big, 0), (2, "v", "x" * 100, 0), (1, "u", "x" * 100, 0), (8, "d", "x" * 99, 0), (9, "d", "x" * 99, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = new_path(spark, "warc-test")
    manifest = write_archives(pages, folder)
    got = read_archives(spark, folder, manifest).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(got) == len(rows)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [j for j, _, h, _ in rows if j is not None and (h or "").encode() == data]
        ref = min(same) if len(data) >= 100 and i != min(same) else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref, b"" if ref else data))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sorted((r.url for r in got), key=repr) == sorted((u for _, u, _, _ in rows), key=repr)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert write_archives(none, new_path(spark, "warc-test")).count() == 0
    where = new_path(spark, "pages")
    none.write.parquet(f"{where}/pages.parquet")
    assert op6_warc(spark, where).count() == 0


def test_every_archive_has_a_dictionary():
    rng = random.Random(2)
    page = lambda n: " ".join(str(rng.random()) for _ in range(n // 19)).encode()
    for count, size in ((40, 200_000), (1, 9_000_000), (1, 100), (1, 0), (20, 1000), (300, 500)):
        records = [warc_record("response", i, "", "d", size, page(size), DATE) for i in range(count)]
        data = pack(records)
        assert 0 < int.from_bytes(data[4:8], "little") <= 32 << 10
        assert list(unpack(data)) == records


def test_small_partitions_share_archives(spark):
    rows = [(i, "u", f"page {i} " * 20) for i in range(64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    folder = new_path(spark, "warc-test")
    manifest = write_archives(pages, folder)
    assert [r.records for r in manifest.collect()] == [64]
    assert {(r.page_id, bytes(r.payload).decode()) for r in read_archives(spark, folder, manifest).collect()} == {(i, html) for i, _, html in rows}


def test_large_identifiers(spark):
    big = 2**53 + 1
    rows = [(big, "u", "x" * 200), (big + 2, "v", "x" * 200), (None, "w", "x" * 200), (2**63 - 1, "z", "short")]
    folder = new_path(spark, "warc-test")
    manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    got = {(r.page_id, r.record_type, r.refers_to) for r in read_archives(spark, folder, manifest).collect()}
    assert got == {(big, "response", None), (big + 2, "revisit", big), (None, "revisit", big), (2**63 - 1, "response", None)}
