import numpy as np
import pyarrow as pa
import xxhash

from tallyframe.llm import bitmap, tokens


def brute(text):
    return [xxhash.xxh64_intdigest(w) for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]


TEXTS = [None, "", "  ", "One two, THREE", "Äé-ß 12x", "...", "a" * 100000, "x y " * 5000]


def test_hashes_equal_brute_force():
    for array in (pa.array(TEXTS), pa.array(["skip", *TEXTS]).slice(1), pa.array([], pa.string()), pa.array([None, ""])):
        hashes, offsets = tokens.token_hashes(array)
        got = [hashes[offsets[i] : offsets[i + 1]].tolist() for i in range(len(array))]
        assert got == [brute(t) for t in array.to_pylist()]


def test_pieces_hold_every_row(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([None, "a" * 500, "", "b" * 90, "c" * 90, "d", "e", None])], ["i", "t"])
    parts = list(tokens.pieces(batch, 1))
    assert len(parts) > 2 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))


def test_filter_misses_nothing(spark):
    rng = np.random.default_rng(1)
    inside = rng.integers(-(2**63), 2**63, 3000)
    outside = rng.integers(-(2**63), 2**63, 100_000)
    filled = bitmap.build(spark.createDataFrame([(int(x),) for x in inside], "h long").repartition(3))
    assert len(bitmap.passing(filled, inside.view(np.uint64))) == 3000
    assert len(bitmap.passing(filled, outside.view(np.uint64))) < 20
    assert not bitmap.build(spark.createDataFrame([], "h long")).any()
