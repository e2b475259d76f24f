import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import media

from .helpers import docs, empty


def brute_cuts(data):
    """Byte by byte."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(media.GEAR[b])) % 2**32
        n = i + 1 - start
        if n >= media.MIN_CHUNK and h >> (32 - media.CUT_BITS) == 0 or n == media.MAX_CHUNK:
            if i + 1 < len(data):
                ends.append(i + 1)
                start = i + 1
    return [*ends, len(data)]


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "é", "tion", "x"]) + str(rng.randrange(1000)) for _ in range(n))


@pytest.mark.parametrize("data", [b"", b"a" * 64, b"\0" * 200_000, long_text(1, 60_000).encode(), np.random.default_rng(1).bytes(300_000)])
def test_cuts_equal_the_rolling_hash(data):
    assert media.cuts(data) == brute_cuts(data)


def expected(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    wav = media.header(len(padded)) + padded
    return (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(wav), hashlib.sha256(wav).hexdigest())


def test_round_trip_with_shared_chunks(spark):
    base = long_text(2, 20_000)
    texts = [None, "", "short", "x" * 64, base, base, "changed " + base, base[:70_000] + "new" + base[70_000:], long_text(3, 3000), long_text(3, 3000) + "end"]
    d = docs(spark, texts)
    stored = media.store(d)
    assert stored.chunks.count() > 5 and stored.chunks.select("digest").distinct().count() == stored.chunks.count()
    held = stored.media.select(F.sum(F.octet_length("own")).alias("n")).first()["n"] + stored.chunks.select(F.sum(F.octet_length("chunk"))).first()[0]
    assert held < 0.6 * sum(len((t or "").encode()) for t in texts)
    got = {r["doc_id"]: r for r in media.describe(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == expected(t), i
    assert got[4]["feature"] == got[5]["feature"] != got[6]["feature"]


def test_wav_is_read_by_the_standard_library(spark):
    import io
    import wave

    data = b"\0\x80\xff" * 64
    with wave.open(io.BytesIO(media.header(len(data)) + data)) as w:
        assert w.readframes(w.getnframes()) == data and w.getsampwidth() == 1


def test_damage_is_an_error(spark):
    stored = media.store(docs(spark, [long_text(5, 2000)]))
    bad = media.Stored(stored.ids, stored.media.withColumn("own", F.encode(F.lit("zz"), "UTF-8")), stored.chunks)
    with pytest.raises(Exception, match="DamagedMedia"):
        media.load(bad).collect()


def test_null_ids_repeated_rows_and_empty_table(spark):
    d = docs(spark, ["abc", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["n_bytes"] for r in media.describe(d.union(d)).collect()) == [0, 0, 3, 3]
    assert media.describe(empty(spark)).count() == 0
