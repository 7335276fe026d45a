"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by (page_id, tie), where tie hashes the rest of the row. The bounds of
the ranges are taken from the rows whose hashes are smallest, so that the same rows always give
the same shards. A shard's task writes gzip members to a file with a temporary name, rolls to
the next when the compressed size is reached, and renames a finished file; its row of the
manifest follows. Files count once the manifest, written last and renamed as a whole, names
them, so a task that is run again leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: F401
from pyspark.sql import functions as F

from .tables import small_batches, text_slices, written

#: Fixed values of the record format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows sampled for each bound, and for all bounds together.
SAMPLE, SAMPLES = 32, 200_000
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "tessella:warc-record")


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: twenty bits at a time, as four digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: int | None, digest: str, tie: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest} {tie}')}>"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, tie: int, refers_to: int | None, date: str) -> bytes:
    """One record, headers regenerated from the payload; a revisit has no payload in its block."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, tie)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files of one shard; what is finished has its final name and its manifest row."""

    def __init__(self, folder: str, shard: int, most: int):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.number, self.out, self.rows = shard, most, 0, None, []

    def add(self, data: bytes, page_id: int | None) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        if self.out is not None and self.size + len(member) > self.most:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.system.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            self.first = page_id
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.temporary, f"{self.path}/{self.name}")
            self.rows.append((self.name, self.shard, self.records, self.size, self.digest.hexdigest(), self.first, self.last))
            self.out, self.number = None, self.number + 1


_MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"


def _write(folder: str, most: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark = None, (None, None)
        for batch in batches:
            for part in text_slices([batch], "html"):
                for shard, page_id, digest, tie, kind, refers, url, html in zip(*(part.column(c).to_pylist() for c in ("shard", "page_id", "digest", "tie", "kind", "refers_to", "url", "html"))):
                    if kind == 0:  # a mark comes right before the rows that it makes revisits
                        mark = ((shard, page_id, digest), refers)
                        continue
                    if files is None or files.shard != shard:
                        if files:
                            files.close()
                            yield _manifest(files.rows)
                        files = _Files(folder, shard, most)
                    refers = mark[1] if mark[0] == (shard, page_id, digest) else None
                    files.add(record(page_id, url, (html or "").encode(), digest, tie, refers, date), page_id)
        if files:
            files.close()
            yield _manifest(files.rows)

    return write


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["file", "shard", "records", "bytes", "sha256", "first_id", "last_id"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, file_bytes: int = 8 << 20, least_payload: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the manifest.

    ``folder`` is a URI that all executors reach. Of rows with equal payloads of at least
    ``least_payload`` bytes the one with the largest page_id is a response and the others
    revisit it. ``shard_bytes`` is the payload of a shard, about, ``file_bytes`` a file's
    compressed size.

    Defined cases: a null html is an empty payload; a null url has no target header; a null
    page_id is smaller than any other; rows that share the largest page_id are all responses,
    as are rows of a payload that no row with an id has; an empty table gives no file.
    """
    spark = pages.sparkSession
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").alias("html"),
        F.length(data).cast("long").alias("size"),
        base32_sha1(data).alias("digest"),
        F.xxhash64("url", data).alias("tie"),
    )
    narrow = written(rows.drop("html", "url"), "pages")
    facts = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, min(facts["n"], -(-facts["bytes"] // shard_bytes)))
    order = F.xxhash64("page_id", "tie")
    sample = sorted(
        (r["page_id"] is not None, r["page_id"] or 0, r["tie"])
        for r in narrow.select("page_id", "tie", order.alias("o")).orderBy("o").limit(min(SAMPLES, SAMPLE * shards)).collect()
    )
    bounds = sorted({sample[i * len(sample) // shards] for i in range(1, shards)}) if sample else []

    def with_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds how many bounds are not after (has an id, page_id, tie), by searches of sorted keys."""
        key = [("known", "i1"), ("page", "i8"), ("tie", "i8")]
        cuts = np.array(bounds, key)
        for batch in batches:
            rows = np.zeros(batch.num_rows, key)
            rows["known"] = batch.column("page_id").is_valid().to_numpy(zero_copy_only=False)
            rows["page"] = batch.column("page_id").fill_null(0).to_numpy()
            rows["tie"] = batch.column("tie").to_numpy()
            shard = np.searchsorted(cuts, rows, "right") if len(cuts) else np.zeros(len(rows), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    first = narrow.where(F.col("size") >= least_payload).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    marks = (
        narrow.where(F.col("size") >= least_payload)
        .join(first, "digest")
        .where("page_id IS NULL OR page_id < refers_to")
        .select("page_id", "tie", "digest", "refers_to")
        .distinct()
    )
    # rows that share id and digest may differ in url, and then sit in different shards
    marked = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "tie", "refers_to", F.lit(0).alias("kind"))
    full = rows.select("page_id", "url", "html", "digest", "tie", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    both = small_batches(full.unionByName(marked))
    dealt = both.mapInArrow(with_shards, "page_id long, url string, html string, digest string, tie long, refers_to long, kind int, shard int")
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "tie")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows_of = ordered.select("shard", "page_id", "digest", "tie", "kind", "refers_to", "url", "html").mapInArrow(_write(folder, file_bytes, date), _MANIFEST)
    temporary = f"{folder}/_manifest-{uuid.uuid4().hex}"
    rows_of.write.parquet(temporary)
    system.move(temporary.removeprefix(folder[: len(folder) - len(path)]), f"{path}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _headers(stream: io.BufferedReader) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
    return out


class _Unzipped(io.RawIOBase):
    """The bytes of a file of gzip members, a chunk at a time."""

    def __init__(self, source):
        self.source, self.unpack, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.held:
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(1 << 20)
                if not self.raw:
                    return 0
            self.held = self.unpack.decompress(self.raw)
            self.raw = b""
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


def records(folder: str, name: str) -> Iterator[dict]:
    """The records of a file; digests are computed again and have to agree."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
        stream = io.BufferedReader(_Unzipped(source), 1 << 20)
        while (h := _headers(stream)) is not None:
            block = stream.read(int(h["content-length"]))
            head, _, payload = block.partition(b"\r\n\r\n")
            http = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
            revisit = h["warc-type"] == "revisit"
            if h["warc-block-digest"] != f"sha1:{sha1(block)}" or not revisit and h["warc-payload-digest"] != f"sha1:{sha1(payload)}":
                raise ValueError(f"a digest of {h['warc-record-id']} in {name} doesn't agree")
            refers, page_id = h.get("x-refers-to-page-id"), h.get("x-page-id")
            yield {
                "page_id": None if page_id is None else int(page_id),
                "url": h.get("warc-target-uri"),
                "payload_bytes": int(http[b"content-length"]),
                "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                "record_type": h["warc-type"],
                "refers_to": None if refers is None else int(refers),
                "record_id": h["warc-record-id"],
                "file": name,
                "payload": None if revisit else payload,
            }


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("payload", pa.binary())]
)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of the records in the files that the manifest of ``folder`` names."""
    fields = [f for f in _RECORD if payloads or f.name != "payload"]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                for r in records(folder, name):
                    held.append({f.name: r[f.name] for f in fields})
                    size += len(r["payload"] or b"") * payloads + 400
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    files = manifest.select("file")
    return files.repartition(max(1, min(manifest.count(), 10_000)), "file").mapInArrow(read, ", ".join(f"{f.name} {kinds[f.type]}" for f in fields))
