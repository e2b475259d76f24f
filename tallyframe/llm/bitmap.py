"""A filter of fixed size over 64-bit hashes, built on the executors.

It says no only to hashes that it was not built from. However many hashes there
are, 2**BITS bits (8 MB) reach the driver and the executors; with very many it
lets more through, which costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITS) - 1)
    return hashes & low, (hashes >> np.uint64(64 - BITS)) & low


def build(hashes: DataFrame) -> np.ndarray:
    """The filter of the first column, well-mixed signed 64-bit hashes."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.unique(np.concatenate(_slots(own)))
            word, bits = slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63))
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            merged = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[starts].view(np.int64)), pa.array(merged.view(np.int64))], ["word", "bits"]
            )

    found = hashes.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    got = found.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def passing(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter doesn't rule out."""
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    a, b = _slots(hashes)
    hit = np.flatnonzero(filled[a >> six] >> (a & low) & one)
    b = b[hit]
    return hit[(filled[b >> six] >> (b & low) & one).astype(bool)]
