"""A deterministic, sharded WARC writer, and the reader of its archives.

Records are range-sorted by a hash of the page id, so shards are equal ranges
of keys, alike in size whatever the ids, urls or payloads, and the same input
gives the same files. A shard is written as a stream; it rolls to its next file
when the compressed size is reached. Headers, record ids and digests are made
anew from the rows. Files are written below temporary names and moved to their
final ones, which end in the digest of their content: no attempt of a task ever
replaces or removes a final file, and equal ones are stored once. The manifest,
written last by Spark from the attempts that it commits, says which files count.

Which records are revisits is decided on digests alone, before any payload is
moved; the decisions travel to the shards as rows that sort just before the
page they are about. So payloads are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.session import scratch

MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def first_of_payload(narrow: DataFrame, least: int) -> DataFrame:
    """page_id, digest, refers_to for the rows that revisit an equal payload with a smaller page_id."""
    large = narrow.where(F.col("bytes") >= least)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return large.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, ordinal: int, date: str) -> bytes:
    """One record, uncompressed: a response, or a revisit that has the HTTP head only."""
    ident = lambda page, n: uuid.UUID(hashlib.sha256(f"{page}|{digest}|{n}".encode()).hexdigest()[:32])
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{ident(page_id, ordinal)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{ident(refers_to, 0)}>", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []), *([f"X-No-URI: {'null' if url is None else 'empty'}"] if not url else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gz(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """The files of one task: open below a temporary name, moved when full or done."""

    def __init__(self, folder: str, level: int, roll_bytes: int, date: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.level, self.roll, self.date, self.out, self.done = level, roll_bytes, date, None, []

    def write(self, shard: int, data: bytes) -> None:
        if self.out is None or shard != self.shard or self.bytes >= self.roll:
            number = self.number + 1 if self.out is not None and shard == self.shard else 0
            self.close()
            self.shard, self.number, self.bytes, self.records, self.sha = shard, number, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:06d}-{number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self._put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.sha256(self.name.encode()).hexdigest()[:32])}>\r\nWARC-Date: {self.date}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        packed = _gz(data, self.level)
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            digest = self.sha.hexdigest()
            name = f"{self.name.removesuffix('.warc.gz')}-{digest[:16]}.warc.gz"
            if not self._there(name):
                try:
                    self.fs.move(self.temporary, f"{self.path}/{name}")
                except OSError:  # another attempt may have been first
                    if not self._there(name):
                        raise
            self.done.append((name, self.shard, self.records, self.bytes, digest))

    def _there(self, name: str) -> bool:
        """Another attempt has stored this content; files appear by a move, so it is whole."""
        return self.fs.get_file_info(f"{self.path}/{name}").type != pyarrow.fs.FileType.NotFound


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 100, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> str:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the folder, which has ``manifest`` with the files that count.

    Of the rows with equal payloads of at least ``least`` bytes, those with the
    smallest page_id are responses (more than one if that row is repeated); the
    others revisit it. Null html is an empty payload; null and empty urls get a
    ``urn:page:`` name and are read back as they were; line breaks in a url are
    written, and read back, as %0D and %0A. Rows without a page_id are written
    (dealt by their payload) and, if equal to a numbered page, revisit it. A task that
    is tried again finds its files there, or adds others that the manifest does not
    name; such count for nothing. An empty table gives an empty manifest. Other
    columns of pages are not read. shard_bytes counts payloads, roll_bytes
    compressed records; a record is never cut.
    """
    spark = pages.sparkSession
    folder = (folder or scratch(spark, "warc")).rstrip("/")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select("page_id", "digest", F.length("payload").alias("bytes"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    key = F.xxhash64("page_id", F.when(F.col("page_id").isNull(), F.col("digest")))
    shard = F.least(F.lit(shards - 1), F.floor((key.cast("double") / 2.0**64 + 0.5) * shards)).cast("long")
    told = first_of_payload(narrow, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
    stream = told.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1))).withColumn("key", key).withColumn("shard", shard)
    dealt = stream.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, level, roll_bytes, date)
        decided, refers, same, ordinal = None, None, None, 0
        for batch in batches:
            for page, url, payload, digest, refers_to, kind, at in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to", "kind", "shard")), strict=True):
                if kind == 0:
                    decided, refers = (page, digest), refers_to
                    continue
                ordinal, same = (ordinal + 1 if same == (page, digest) else 0), (page, digest)
                files.write(at, record(page, url, payload, digest, refers if decided == same else None, ordinal, date))
        files.close()
        if files.done:
            names, ats, records, sizes, shas = zip(*files.done, strict=True)
            yield pa.record_batch({"file": pa.array(names), "shard": pa.array(ats, pa.int64()), "records": pa.array(records, pa.int64()), "bytes": pa.array(sizes, pa.int64()), "sha256": pa.array(shas)})

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)  # of lost attempts; every file that counts has its name
    return folder


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each gzip member's record; the block's digest is checked."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("archive ends within a record")
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        block = rest[: int(headers["content-length"])]
        want = headers.get("warc-block-digest")
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or want and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"broken record {headers.get('warc-record-id')}")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Of responses, size and digest are those of the payload as read back, which
    must agree with the header; of revisits, they are the headers'. Files are
    checked against the manifest's digests. A file is read by one task; its
    size is bounded where it was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows = []
                for headers, block in parse_records(data):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, digest = int(head.rpartition(b"Content-Length: ")[2]), headers["warc-payload-digest"].removeprefix("sha256:")
                    response = headers["warc-type"] == "response"
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"broken payload of {headers['warc-record-id']}")
                    page, refers = headers.get("x-page"), headers.get("x-refers-to-page")
                    rows.append((page and int(page), {"null": None, "empty": ""}.get(headers.get("x-no-uri"), headers["warc-target-uri"]), size, digest, headers["warc-type"], refers and int(refers), payload if response else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                yield pa.record_batch(cols[: 7 if with_payload else 6], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if with_payload else 6])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "sha256")
    files = max(1, manifest.count())
    return manifest.repartition(files, "file").mapInArrow(run, RECORDS + ", payload binary" * with_payload)
