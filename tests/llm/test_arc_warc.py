from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askahead.llm import arc_warc as A

PAGES = "page_id bigint, url string, html string, digest string, file string"


def pages_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


TRICKY = ["", "\r\n\r\n", "plain", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "http://a/ 0.0.0.0 20200101000000 text/html 5\nabcde\n",
          "é日本 " * 50, "\n\n\n", "x" * 300_000, "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\n"]


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        again = n >= min_bytes and first.get(h or "", i) != i
        out.append((i, n, b32(h), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_records_survive_both_versions(version):
    parts = [A._member(A.arc_version_block("f.arc", version, "20200101000000"))]
    for i, html in enumerate(TRICKY):
        parts.append(A._member(A.arc_record(version, "f.arc", 0, f"http://a b/{i}\n?é", "20200102", i, html.encode())))
    records = list(A.parse_arc(b"".join(parts)))
    assert [r.http[2].decode() for r in records] == TRICKY
    assert [r.http[1]["x-page-id"] for r in records] == [str(i) for i in range(len(TRICKY))]
    assert list(records[0].fields) == A.ARC_FIELDS[version]
    assert records[0].fields["URL"] == "http://a%20b/0%0A?é"
    warc = b"".join([A._member(A.warc_info("f"))] + [A._member(A.warc_of(r, None)) for r in records])
    back = list(A.parse_warc(warc))
    assert back[0][0]["WARC-Type"] == "warcinfo"
    for record, (fields, block) in zip(records, back[1:], strict=True):
        assert block == record.block
        assert fields["WARC-Date"] == "2020-01-02T00:00:00Z"
        assert fields["WARC-Payload-Digest"] == "sha1:" + A.payload_digest(record.http[2])
    assert len({f["WARC-Record-ID"] for f, _ in back}) == len(back)


def test_each_record_is_a_gzip_member():
    data = A._member(b"one") + A._member(b"two" * 100_000) + A._member(b"")
    assert [c for _, c in A.members(data)] == [b"one", b"two" * 100_000, b""]
    at = [o for o, _ in A.members(data)]
    assert gzip.decompress(data[at[1] : at[2]]) == b"two" * 100_000
    with pytest.raises(ValueError, match="cut off"):
        list(A.members(data[: at[1] + 20]))


def test_broken_archives_are_refused():
    head = A._member(A.arc_version_block("f", 1, "20200101"))
    with pytest.raises(ValueError, match="shorter than declared"):
        list(A.parse_arc(head + A._member(b"\nhttp://a 0.0.0.0 2020 text/html 50\nabc\n")))
    with pytest.raises(ValueError, match="fields"):
        list(A.parse_arc(head + A._member(b"\nhttp://a 0.0.0.0 2020 3\nabc\n")))
    with pytest.raises(ValueError, match="version"):
        list(A.parse_arc(A._member(b"filedesc://f 0.0.0.0 2020 text/plain 9\n3 0 x\nURL what\n")))
    with pytest.raises(ValueError, match="WARC"):
        list(A.parse_warc(A._member(b"HTTP/1.1 200 OK\r\n\r\n")))


@pytest.mark.parametrize("date", ["2020", "202003", "20200304050607"])
def test_dates(date):
    assert A.iso_date(date) == {"2020": "2020-01-01T00:00:00Z", "202003": "2020-03-01T00:00:00Z"}.get(date, "2020-03-04T05:06:07Z")


@pytest.mark.parametrize(("min_bytes", "file_bytes", "version"), [(0, 16 << 20, None), (20, 300, 1), (0, 300, 2)])
def test_pages_come_back(spark, min_bytes, file_bytes, version):
    rng = random.Random(min_bytes)
    rows = [(i, f"http://h/{i % 7}", rng.choice([*TRICKY, f"<p>{i}</p>"])) for i in range(120)]
    rng.shuffle(rows)
    df = A.pages_through_warc(pages_table(spark, rows).repartition(4), min_bytes, file_bytes=file_bytes, version=version)
    assert got(df) == brute(rows, min_bytes)


def test_odd_rows(spark):
    rows = [(None, None, "same"), (4, "u", "same"), (4, "u", "same"), (9, None, None), (8, "", ""), (None, "v", "alone"), (None, "v", "alone")]
    result = got(A.pages_through_warc(pages_table(spark, rows)))
    assert [r for r in result if r[0] in (8, 9)] == [(8, 0, b32(""), "response", None), (9, 0, b32(""), "revisit", 8)]
    assert sorted(r[3:] for r in result if r[0] == 4) == [("response", None), ("revisit", 4)]
    assert sorted((r[2] == b32("same"), *r[3:]) for r in result if r[0] is None) == [
        (False, "response", None), (False, "revisit", None), (True, "revisit", 4)]
    assert A.pages_through_warc(pages_table(spark, rows).limit(0)).collect() == []


def test_revisits_name_the_response(spark):
    pages = pages_table(spark, [(1, "http://a", "x"), (2, "http://b", "x")])
    folder, files = A.convert(*A.write_arcs(pages))
    records = [f for r in files.collect() for f, _ in A.parse_warc(A.read_file(folder, r.file))]
    by_type = {f["WARC-Type"]: f for f in records}
    assert by_type["revisit"]["WARC-Refers-To"] == by_type["response"]["WARC-Record-ID"]
    assert by_type["revisit"]["WARC-Profile"] == A.REVISIT_PROFILE


def test_files_are_dealt_to_all_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages_table(spark, [(i, f"http://{i}", f"page {i} " * 50) for i in range(60)]).repartition(2)
    folder, files = A.write_arcs(pages, file_bytes=300)
    n = files.count()
    assert n > tasks
    index = A.dealt(files.select("file", F.lit("revisits").alias("more"))).withColumn("task", F.spark_partition_id())
    rows = index.collect()
    sizes = Counter(r.task for r in rows)
    assert len(rows) == n and len(sizes) == tasks and max(sizes.values()) - min(sizes.values()) <= 1
    # Conversion keeps a file each, made by as many tasks.
    assert A.convert(folder, files)[1].count() == n
