"""WARC archives: a gzip member per record, written and read by executors.

``write`` lays out one record per page. Of pages with equal payloads of
``MIN_SHARED`` bytes or more, the one with the largest id is a ``response``
record; the others are ``revisit`` records that refer to it and hold its headers
only. Each task streams its records into archives of about ``ARCHIVE_BYTES``
under names of their own, and returns a manifest row for each finished archive.
The manifest is a Parquet table, so that only the archives of tasks that Spark
counts as successful are ever read; those of lost or repeated attempts are not.

``read`` takes archives in sequence: members are inflated piece by piece, headers
end at the blank line, the block is framed by Content-Length, and block and
payload digests are verified as the bytes pass. A record that breaks off, has a
wrong digest or more bytes than it states raises an error.

Edge cases: null html is an empty payload; null url is an empty target; rows with
the same id and equal payload are all responses if theirs is the largest id; a
null id sorts below all others, and a group of null ids alone is all responses;
extra columns are not read; an empty table gives an empty archive list.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch_path

MIN_SHARED = 1000
ARCHIVE_BYTES = 256 << 20
#: Copies of the list of shared digests, so that one digest's pages spread over as many tasks.
SALT = 16
PIECE = 1 << 16
_NO_DATE = "1970-01-01T00:00:00Z"


# Names that Hadoop has for stores that Arrow names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def arrow_uri(uri: str) -> str:
    """The same place under the scheme that Arrow's file systems know."""
    scheme, sep, rest = uri.partition("://")
    return f"{_SCHEMES.get(scheme.lower(), scheme)}://{rest}" if sep else uri


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def plan(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, sha1 (hex) and, for revisits, refers_to."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # Digests and ids alone find the shared payloads, combined before the shuffle. The list is written, so the
    # planner knows its size: payloads stay where they are unless it is large.
    shared = (
        rows.where(F.octet_length("payload") >= min_shared)
        .groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
        .where("n > 1")
        .select("sha1", "target")
    )
    shared = materialize(shared, "shared").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    return salted.join(shared, ["sha1", "salt"], "left").select(
        "page_id",
        "url",
        "payload",
        "sha1",
        F.when((F.octet_length("payload") >= min_shared) & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"),
    )


def record(page_id, url: str, payload: bytes, digest: bytes, refers_to) -> bytes:
    """A WARC record without compression."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_NO_DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def _written(batches, folder: str, archive_bytes: int):
    import uuid

    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)
    out, name, records, size = None, "", 0, 0
    done = []

    def close():
        nonlocal out
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
            out = None

    for batch in batches:
        for page_id, url, payload, sha1, refers_to in zip(*(c for c in batch.columns), strict=True):
            if out is None:
                name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
            body = payload.as_buffer().to_pybytes()
            data = _member(record(page_id.as_py(), url.as_py(), body, bytes.fromhex(sha1.as_py()), refers_to.as_py()))
            out.write(data)
            records, size = records + 1, size + len(data)
            if size >= archive_bytes:
                close()
    close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
        ["path", "records", "bytes"],
    )


def write(pages: DataFrame, folder: str | None = None, min_shared: int = MIN_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) as a table that has been written, too."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    manifest = f"{folder}/manifest"
    plan(pages, min_shared).mapInArrow(
        lambda b: _written(b, f"{folder}/archives", archive_bytes), "path string, records bigint, bytes bigint"
    ).write.parquet(manifest)
    return spark.read.schema("path string, records bigint, bytes bigint").parquet(manifest)


class BadRecord(ValueError):
    """An archive that doesn't hold what its records state."""


class _Member:
    """Bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.ready = stream, rest, b""
        self.gz = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate the next piece; False at the member's end."""
        while not self.gz.eof:
            source = self.gz.unconsumed_tail or self.raw or self.stream.read(PIECE)
            if not source:
                raise BadRecord("an archive ends within a record")
            self.raw = b""
            try:
                got = self.gz.decompress(source, PIECE)
            except zlib.error as error:
                raise BadRecord(str(error)) from error
            if got:
                self.ready += got
                return True
        return False

    def head(self) -> dict[str, str]:
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise BadRecord("a record has no end of headers")
        lines = self.ready[:end].decode("utf-8").split("\r\n")
        self.ready = self.ready[end + 4 :]
        return {"": lines[0]} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def pieces(self, size: int):
        while size:
            if not self.ready and not self.more():
                raise BadRecord("a block is shorter than its Content-Length")
            got, self.ready = self.ready[:size], self.ready[size:]
            size -= len(got)
            yield got

    def finish(self) -> bytes:
        """The rest must be the record's closing lines; what follows belongs to the next member."""
        while self.more():
            if len(self.ready) > 4:
                break
        if self.ready != b"\r\n\r\n" or self.more():
            raise BadRecord("a block is longer than its Content-Length")
        return self.gz.unused_data


def records(stream, keep_payload: bool = False):
    """Records of a gzip stream in order: dicts of headers and verified digests."""
    rest = b""
    while rest or (rest := stream.read(PIECE)):
        member = _Member(stream, rest)
        head = member.head()
        if not head[""].startswith("WARC/"):
            raise BadRecord("not a WARC record")
        block, payload, kept, size, http = hashlib.sha1(), hashlib.sha1(), [], 0, b""
        found: dict[str, str] | None = None
        for piece in member.pieces(int(head["content-length"])):
            block.update(piece)
            if found is None:
                http += piece
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                found = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http[:end].decode("latin-1").split("\r\n")[1:])}
                piece = http[end + 4 :]
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        rest = member.finish()
        stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
        if _base32(block.digest()) != head["warc-block-digest"].removeprefix("sha1:"):
            raise BadRecord(f"block digest of {head['warc-record-id']}")
        length = int((found or {}).get("content-length", size))
        if head["warc-type"] == "response" and (payload.digest() != stated or size != length):
            raise BadRecord(f"payload digest of {head['warc-record-id']}")
        yield {
            "type": head["warc-type"],
            "id": head["warc-record-id"],
            "url": head["warc-target-uri"],
            "refers_to": head.get("warc-refers-to"),
            "payload_bytes": length,
            "payload_digest": stated.hex(),
            "payload": b"".join(kept) if keep_payload and head["warc-type"] == "response" else None,
        }


def _page_of(urn: str | None):
    value = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value in (None, "None") else int(value)


ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches, keep_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    width = len(names) if keep_payload else len(names) - 1

    def packed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:width], kinds[:width], strict=True)], names[:width])

    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            filesystem, at = _filesystem(path)
            rows, held, count = [], 0, 0
            with filesystem.open_input_stream(at, compression=None) as stream:
                for r in records(stream, keep_payload):
                    count += 1
                    rows.append((_page_of(r["id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["type"], _page_of(r["refers_to"]), r["payload"]))
                    held += len(r["payload"] or b"") + 200
                    if held > 4 << 20:
                        yield packed(rows)
                        rows, held = [], 0
            if count != expected:
                raise BadRecord(f"{path} has {count} records and should have {expected}")
            if rows:
                yield packed(rows)


def read(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives in the manifest, digests verified."""
    spark = manifest.sparkSession
    # The manifest is a row per archive; as many tasks as archives, at most what a shuffle would have.
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path", "records").repartition(tasks).mapInArrow(
        lambda b: _read(b, keep_payload), ROWS + (", payload binary" if keep_payload else "")
    )
