"""Media columns: payloads kept as content-defined chunks.

A payload becomes an 8-bit mono WAV file: a header of 44 bytes and the payload's
bytes as samples. A rolling gear hash over the samples cuts them where its high
bits are zero, so that cuts depend on content and shift with it. Chunks are named by
a 128-bit BLAKE2 digest; an ordered list of names rebuilds a payload.

``store`` finds by joins on digests alone which chunks more than one payload
holds. Those go once into a chunk table; all others stay in the row of the only
payload that has them, next to its chunk list, so that the bulk of the bytes is
written where it is read and never shuffled. Equal payloads share one row.
``load`` rebuilds every payload from the written tables, checks each chunk's digest
and the whole's, and raises an error where one differs.

Edge cases: null and empty texts are one payload of 64 zero bytes; repeated rows
and equal texts share what is stored and give equal values; null ids are kept;
clashing extra columns aren't read; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch_path
from .bitmap import build, passing

UNIT = 64
RATE = 8000
#: Mean chunk of 4 kB: a cut where the high 12 bits of the hash are zero.
CUT_BITS = 12
MIN_CHUNK = 1 << 10
MAX_CHUNK = 1 << 15
#: Payloads that a task remembers, to pass each on once.
REMEMBERED = 200_000


def _gear() -> np.ndarray:
    """256 pseudo-random 32-bit values from a rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


with np.errstate(over="ignore"):
    GEAR = _gear()


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + table[data[i]] modulo 2**32, for all i at once.

    The hash sees 32 bytes; sums over 1, 2, 4, ... bytes double up to that window.
    """
    h = table[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width].copy() << np.uint32(width)
    return h


def cuts(data: bytes, table: np.ndarray = GEAR) -> list[int]:
    """Ends of the chunks; the last is the length."""
    raw, ends, start, size = np.frombuffer(data, dtype=np.uint8), [], 0, len(data)
    marks = []
    for at in range(0, size, 1 << 20):  # a payload is hashed in pieces with 31 bytes of overlap
        low = max(0, at - 31)
        h = gear_hashes(raw[low : at + (1 << 20)], table)[at - low :]
        # The mask takes high bits, which all 32 bytes reach.
        marks.append(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    for mark in np.concatenate(marks).tolist() if marks else []:
        while mark - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if mark - start >= MIN_CHUNK and mark < size:
            ends.append(mark)
            start = mark
    while size - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if size > start or not size:
        ends.append(size)
    return ends


def chunk_name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def header(samples: int) -> bytes:
    """WAV header of 8-bit mono samples; sizes beyond 32 bits are marked as such by the format."""
    cap = lambda n: min(n, 0xFFFFFFFF)
    return (
        b"RIFF" + struct.pack("<I", cap(36 + samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", cap(samples))
    )


def _payloads(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(text)
    pad = F.when(size == 0, F.lit(UNIT)).otherwise(F.pmod(-size, F.lit(UNIT)))
    padded = F.concat(text, F.substring(F.lit(b"\0" * UNIT), F.lit(1), pad))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("n_bytes"), padded.alias("payload")).withColumn(
        "sha", F.unhex(F.sha2("payload", 256))
    )


def _names(batches):
    """(digest, sha, seq) of every chunk; a task names a payload once."""
    seen: set[bytes] = set()
    for batch in batches:
        digest, sha, seq = [], [], []
        for k in range(batch.num_rows):
            own = batch.column(0)[k].as_py()
            if own in seen:
                continue
            if len(seen) < REMEMBERED:
                seen.add(own)
            data, start = batch.column(1)[k].as_buffer().to_pybytes(), 0
            for i, end in enumerate(cuts(data, GEAR)):
                digest.append(chunk_name(data[start:end]))
                sha.append(own)
                seq.append(i)
                start = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(sha, pa.binary()), pa.array(seq, pa.int32())], ["digest", "sha", "seq"]
        )


def _maybe(filled):
    """Whether the filter may hold a hash."""

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(hashes), dtype=bool)
        out[passing(filled.value, hashes.to_numpy().view(np.uint64))] = True
        return pd.Series(out)

    return maybe


def _once(batches):
    """Each payload once, as far as the task remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k, own in enumerate(batch.column(0).to_pylist()):
            if own not in seen:
                keep.append(k)
                if len(seen) < REMEMBERED:
                    seen.add(own)
        yield batch.take(pa.array(keep, pa.int64()))


_ROW = "sha binary, header binary, names array<binary>, sizes array<int>, shared array<int>, own binary, lent array<struct<digest:binary,chunk:binary>>"


def _packed(batches):
    """Rows to store: private chunks in one string, and the shared ones that this payload supplies."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("chunk", pa.binary())]))
    for batch in batches:
        out = {n: [] for n in ("sha", "header", "names", "sizes", "shared", "own", "lent")}
        held = 0

        def done(out=out):
            types = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), kind]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

        for k in range(batch.num_rows):
            data, start = batch.column("payload")[k].as_buffer().to_pybytes(), 0
            shared = {x["seq"]: x["lends"] for x in batch.column("held")[k].as_py() or []}
            names, sizes, own, lent = [], [], [], []
            for i, end in enumerate(cuts(data, GEAR)):
                chunk = data[start:end]
                names.append(chunk_name(chunk))
                sizes.append(end - start)
                if i not in shared:
                    own.append(chunk)
                elif shared[i]:
                    lent.append({"digest": names[-1], "chunk": chunk})
                start = end
            row = (batch.column("sha")[k].as_py(), header(len(data)), names, sizes, sorted(shared), b"".join(own), lent)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
            held += len(data)
            if held > 8 << 20:
                yield done()
                held = 0
                for column in out.values():
                    column.clear()
        yield done()


@dataclass(frozen=True)
class Stored:
    """The written tables: a row per input row, one per distinct payload, and the shared chunks."""

    ids: DataFrame
    media: DataFrame
    chunks: DataFrame


def store(docs: DataFrame) -> Stored:
    spark = docs.sparkSession
    rows = _payloads(docs)
    ids = materialize(rows.select("doc_id", "n_bytes", "sha"), "ids")
    names = materialize(rows.select("sha", "payload").mapInArrow(_names, "digest binary, sha binary, seq int"), "names")
    # A digest is shared if the first and last place that holds it differ.
    place = F.struct("sha", "seq")
    shared = (
        names.groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("digest", F.col("first.sha").alias("owner"), F.col("first.seq").alias("owner_seq"))
    )
    held = (
        names.join(shared, "digest")
        .select("sha", "seq", ((F.col("sha") == F.col("owner")) & (F.col("seq") == F.col("owner_seq"))).alias("lends"))
        .distinct()
        .groupBy("sha")
        .agg(F.collect_list(F.struct("seq", "lends")).alias("held"))
    )
    copies = ids.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    special = materialize(copies.join(held, "sha", "full"), "special")
    # A filter of fixed size tells the payloads that are alone and share nothing, which are most: they are packed
    # where they are read. Only the others are shuffled, each copy once from every task.
    filled = spark.sparkContext.broadcast(build(special.select(F.xxhash64("sha"))))
    maybe = _maybe(filled)(F.xxhash64("sha"))
    nothing = F.lit(None).cast("array<struct<seq:int,lends:boolean>>")
    alone = rows.where(~maybe).select("sha", "payload", nothing.alias("held"))
    others = rows.where(maybe).select("sha", "payload").mapInArrow(_once, "sha binary, payload binary")
    kept = others.join(special, "sha", "left").dropDuplicates(["sha"]).select("sha", "payload", "held")
    path = scratch_path(spark, "media")
    alone.mapInArrow(_packed, _ROW).union(kept.mapInArrow(_packed, _ROW)).write.option("compression", "zstd").parquet(path)
    media = spark.read.schema(_ROW).parquet(path)
    return Stored(ids, media, media.select(F.explode("lent").alias("c")).select("c.digest", "c.chunk"))


class DamagedMedia(ValueError):
    """Stored bytes that aren't what their digests say."""


def _features(payload: bytes, names: list[bytes], sizes: list[int]) -> str:
    """Chunks, distinct chunks, mean and largest sample, entropy of the samples in thousandths of a bit, a digest of the list."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256).astype(np.int64)
    n = len(payload)
    some = counts[counts > 0] / n
    bits = int(round(1000 * float(-(some * np.log2(some)).sum())))
    mean = int((counts * np.arange(256)).sum()) * 1000 // n
    return f"chunks={len(names)};distinct={len(set(names))};mean={mean};peak={int(np.flatnonzero(counts)[-1])};bits={bits};list={chunk_name(b''.join(names)).hex()}"


_MEDIA = "sha binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _rebuilt(batches):
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            get = lambda c: batch.column(c)[k]  # noqa: B023, E731
            names, sizes, own = get("names").as_py(), get("sizes").as_py(), get("own").as_buffer().to_pybytes()
            fetched = {x["seq"]: x["chunk"] for x in get("fetched").as_py() or []}
            parts, at = [], 0
            for i, (name, size) in enumerate(zip(names, sizes, strict=True)):
                if i in fetched:
                    part = fetched[i]
                else:
                    part, at = own[at : at + size], at + size
                if len(part) != size or chunk_name(part) != name:
                    raise DamagedMedia(f"chunk {i} of {get('sha').as_py().hex()}")
                parts.append(part)
            payload = b"".join(parts)
            digest = hashlib.sha256(payload)
            if digest.digest() != get("sha").as_py():
                raise DamagedMedia(get("sha").as_py().hex())
            head = get("header").as_py()
            whole = hashlib.sha256(head)
            whole.update(payload)
            rows.append(
                (digest.digest(), len(payload), digest.hexdigest(), zlib.crc32(payload[-UNIT:]), len(head) + len(payload), whole.hexdigest(), _features(payload, names, sizes))
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _MEDIA.split(", ")])


def load(stored: Stored) -> DataFrame:
    """A row per stored payload, rebuilt and verified: sha and what was computed from the bytes read back."""
    media = stored.media.select("sha", "header", "names", "sizes", "shared", "own")
    none = F.lit(None).cast("array<struct<seq:int,chunk:binary>>")
    whole = media.where(F.size("shared") == 0).withColumn("fetched", none)
    apart = media.where(F.size("shared") > 0)
    wanted = apart.select("sha", F.explode("shared").alias("seq"), "names").select("sha", "seq", F.get("names", "seq").alias("digest"))
    fetched = (
        wanted.join(stored.chunks, "digest").groupBy("sha").agg(F.collect_list(F.struct("seq", "chunk")).alias("fetched"))
    )
    # A payload with a missing chunk stays in, and fails when it is rebuilt.
    joined = apart.join(fetched, "sha", "left")
    columns = ["sha", "header", "names", "sizes", "own", "fetched"]
    return whole.select(columns).mapInArrow(_rebuilt, _MEDIA).union(joined.select(columns).mapInArrow(_rebuilt, _MEDIA))


def describe(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs``, read them back, and give each row its payload's values."""
    stored = store(docs)
    read_back = materialize(load(stored).dropDuplicates(["sha"]), "described")
    return stored.ids.join(read_back, "sha").drop("sha")
