import base64
import gzip
import hashlib
import os

from tessella.llm.tables import new_folder
from tessella.llm.warc import read_warc, records, write_warc

DDL = "page_id long, url string, html string, digest string, size int, shard int, kind string, tie long"
PAGES = [
    (1, "http://a/ b\r\n", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (7, "http://c", "<p>same</p>"),
    (7, "http://d", "<p>same</p>"),
    (3, "http://e", None),
    (4, "http://f", ""),
    (5, "http://g", "é😀\n" * 5000),
    (6, "http://h", "<b>one</b>\r\n\r\nWARC/1.1\r\n"),
    (None, "http://i", "<p>same</p>"),
    (None, None, "only without an id"),
    (8, "http://j", "twice"),
    (8, "http://j", "twice"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1, 2, "k", 3) for r in rows], DDL)


def expected():
    top = {}
    for p, _, h in PAGES:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, _, h in PAGES:
        data, best = (h or "").encode(), top.get(h or "")
        first = best is None or p == best
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best))
    return sorted(out, key=str)


def rows_of(read):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()), key=str)


def test_round_trip(spark):
    for options in ({}, {"shard_bytes": 2000, "file_bytes": 300}):
        folder = new_folder(spark, "warc-test")
        write_warc(frame(spark), folder, **options)
        assert rows_of(read_warc(spark, folder)) == expected()
        payloads = {r.page_id: bytes(r.payload) for r in read_warc(spark, folder).where("record_type = 'response' AND page_id IN (5, 6)").collect()}
        assert payloads == {5: PAGES[6][2].encode(), 6: PAGES[7][2].encode()}


def test_same_rows_give_the_same_files(spark):
    sums = []
    for n in (1, 5):
        folder = new_folder(spark, "warc-test")
        manifest = write_warc(frame(spark).repartition(n), folder, shard_bytes=2000, file_bytes=300)
        sums.append(sorted((r.file, r.records, r.sha256) for r in manifest.collect()))
        path = folder.removeprefix("file://")
        assert sorted(f for f in os.listdir(path) if f.endswith(".gz")) == [f for f, *_ in sums[-1]]
        assert all(hashlib.sha256(open(f"{path}/{f}", "rb").read()).hexdigest() == s for f, _, s in sums[-1])
    assert sums[0] == sums[1] and len(sums[0]) > 2


def test_files_are_gzip_members_with_digests(spark):
    folder = new_folder(spark, "warc-test")
    name = write_warc(frame(spark), folder).first().file
    path = f"{folder.removeprefix('file://')}/{name}"
    whole = gzip.open(path).read()
    assert whole.count(b"WARC-Record-ID: <urn:uuid:") == len(PAGES)
    assert len({r["record_id"] for r in records(folder, name)}) == len(PAGES) - 1  # equal rows have equal ids
    broken = whole.replace(b"<b>one</b>", b"<b>two</b>")
    with gzip.open(path, "wb") as out:
        out.write(broken)
    try:
        list(records(folder, name))
    except ValueError as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("a changed payload went unnoticed")


def test_empty(spark):
    folder = new_folder(spark, "warc-test")
    assert write_warc(frame(spark, []), folder).count() == 0
    assert read_warc(spark, folder).count() == 0
