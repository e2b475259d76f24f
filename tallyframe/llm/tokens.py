"""Normalised word tokens as 64-bit hashes, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at once, so that a batch of very long texts stays small.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``PIECE`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(sizes) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): row i has hashes[offsets[i]:offsets[i + 1]].

    Tokens are runs of letters and digits in lower case; a null text has none.
    """
    import xxhash

    clean = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    clean = pc.utf8_trim(pc.replace_substring_regex(clean, r"[^\p{L}\p{N}]+", " "), " ")
    split = pc.split_pattern(clean, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    digest = xxhash.xxh64_intdigest
    unique = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    hashes = unique[coded.indices.to_numpy(zero_copy_only=False)] if len(unique) else np.empty(0, np.uint64)
    offsets = offsets - offsets[0]
    # A text without words splits into one empty token.
    blank = pc.equal(pc.binary_length(clean), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        keep = np.ones(len(hashes), dtype=bool)
        keep[offsets[:-1][blank]] = False
        hashes = hashes[keep]
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - blank)])
    return hashes, offsets
