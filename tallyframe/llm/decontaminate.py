"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens in a window and ignore the rest, so that a
substituted word spoils only the windows that look at it. Hashes of the
benchmark's windows and of the documents' windows are joined; around every hit
item and document are laid side by side without gaps, and the pair counts as an
overlap if ``min_tokens`` aligned tokens in a row (the whole item if it is
shorter) agree in at least ``similarity`` of their positions. However the
substitutions lie, one window of every overlap is free of them (``masks_of``).

The documents are scanned once. A bitmap of fixed size, filled from the
benchmark's hashes whatever their number, drops nearly all windows that can't
join before anything is shuffled; a false hit there only costs a lookup in the
join. Hits close together become one region, a row with the tokens around them,
as far as the longest item reaches, so that an alignment is counted whole.

Edge cases: null and empty texts, and items without words, overlap nothing;
shorter items have masks of their own length; repeated rows and equal ids
give one row; null ids are carried as null; clashing extra columns are not read;
empty tables on either side give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import build, mix, passing
from ..storage import materialize
from .tokens import pieces, token_hashes

MIN_TOKENS = 13
SIMILARITY = 0.8

_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the picked tokens of every full window."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    factor = _ODD
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out += tokens[k : k + n] * factor
            factor = factor * _ODD + np.uint64(2 * k)
        return mix(out)


def masks_of(need: int, similarity: float) -> list[str]:
    """Masks one of which, at some place, misses all substitutions that ``need`` tokens may have.

    Of m + 2 runs of tokens, m substitutions leave two whole, at a distance of 1 to
    m + 1 runs. Where the runs would be shorter than three tokens, the tokens are
    cut into blocks, and each mask leaves out another choice of m blocks.
    """
    m = need - max(1, int(np.ceil(similarity * need - 1e-9)))
    if not m:
        return ["1" * need]
    run = need // (m + 2)
    if run >= 3:
        return ["1" * run + "0" * (run * gap) + "1" * run for gap in range(m + 1)]
    blocks = np.array_split(np.arange(need), need if m == 1 else min(need, m + 3))
    out = []
    for left in combinations(blocks, m):
        spoilt = set(np.concatenate(left).tolist())
        out.append("".join("0" if k in spoilt else "1" for k in range(need)))
    return out


def _masks_for(lengths: list[int], min_tokens: int, similarity: float) -> list[tuple[int, str]]:
    """(need, mask) for each number of tokens in a row that an item of these lengths needs."""
    return [(need, mask) for need in sorted({min(n, min_tokens) for n in lengths if n > 0}) for mask in masks_of(need, similarity)]


def _token_rows(batches):
    for batch in batches:
        for piece in pieces(batch, 1):
            hashes, offsets = token_hashes(piece.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["item_id", "tokens"])


def _item_hashes(batches, masks, min_tokens):
    for batch in batches:
        out = {"mask": [], "hash": [], "item_id": [], "at": []}
        for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for m, (need, mask) in enumerate(masks):
                if need != min(len(own), min_tokens):
                    continue
                hashes = window_hashes(own, mask)
                out["mask"] += [m] * len(hashes)
                out["hash"] += hashes.view(np.int64).tolist()
                out["item_id"] += [item] * len(hashes)
                out["at"] += range(len(hashes))
        yield pa.RecordBatch.from_pydict(
            out, schema=pa.schema([("mask", pa.int32()), ("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])
        )


def _regions(batches, filled, masks, reach):
    """Rows of (doc_id, tokens, hits) around the windows that pass the filter, ``reach`` tokens to either side."""
    import xxhash

    kind = pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))
    for batch in batches:
        for piece in pieces(batch, 1):
            tokens, offsets = token_hashes(piece.column(1))
            found = [np.empty((4, 0), np.int64)]
            for m, (_, mask) in enumerate(masks):
                hashes = window_hashes(tokens, mask)
                at = passing(filled.value, hashes)
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + len(mask) <= offsets[row + 1]
                found.append(np.stack([at[inside], np.full(inside.sum(), m), row[inside], hashes[at[inside]].view(np.int64)]))
            at, which, row, hashes = np.concatenate(found, axis=1)
            order = np.argsort(at, kind="stable")
            at, which, row, hashes = at[order], which[order], row[order], hashes[order]
            cut = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(row) != 0)) + 1
            ids, regions, toks, hits = piece.column(0), [], [], []
            for part in np.split(np.arange(len(at)), cut):
                if not len(part):
                    continue
                r = row[part[0]]
                first = max(offsets[r], at[part[0]] - reach)
                last = min(offsets[r + 1], at[part[-1]] + reach)
                own = tokens[first:last]
                regions.append((ids[int(r)].as_py(), int(first - offsets[r])))
                toks.append(own.view(np.int64))
                hits.append([{"mask": int(which[p]), "hash": int(hashes[p]), "at": int(at[p] - first)} for p in part])
            key = [xxhash.xxh64_intdigest(t.tobytes() + repr(r).encode()) for t, r in zip(toks, regions, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(key, dtype=np.uint64).view(np.int64)),
                    pa.array([r[0] for r in regions], pa.int64()),
                    pa.array([r[1] for r in regions], pa.int64()),
                    pa.array(toks, pa.list_(pa.int64())),
                    pa.array(hits, kind),
                ],
                ["region", "doc_id", "start", "tokens", "hits"],
            )


def best_overlap(document: np.ndarray, item: np.ndarray, shift: int, min_tokens: int, similarity: float) -> int:
    """Aligned equal tokens if some stretch is similar enough, else 0; item[k] lies on document[k + shift]."""
    a, b = max(0, -shift), min(len(item), len(document) - shift)
    need = min(min_tokens, len(item))
    if b - a < need:
        return 0
    equal = item[a:b] == document[a + shift : b + shift]
    run = np.concatenate([[0], np.cumsum(equal)])
    if (run[need:] - run[:-need]).max() < similarity * need - 1e-9:
        return 0
    return int(run[-1])


def _verified(batches, min_tokens, similarity):
    for batch in batches:
        matched = [
            best_overlap(d.values.to_numpy(zero_copy_only=False), i.values.to_numpy(zero_copy_only=False), s, min_tokens, similarity)
            for s, d, i in zip(batch.column("shift").to_pylist(), batch.column("tokens"), batch.column("item_tokens"), strict=True)
        ]
        size = [len(i.values) for i in batch.column("item_tokens")]
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array(matched, pa.int64()), pa.array(size, pa.int64()), batch.column("start")],
            ["doc_id", "item_id", "matched", "item_tokens", "start"],
        )
        yield out.filter(pa.array([m > 0 for m in matched], pa.bool_()))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, id_column: str = "doc_id"
) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, matched, item_tokens, start.

    ``matched`` is the largest number of equal aligned tokens, ``start`` the token
    of the document where the first such region begins.
    """
    spark = docs.sparkSession
    items = materialize(
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
            _token_rows, "item_id bigint, tokens array<bigint>"
        ),
        "items",
    )
    # No alignment reaches further from a hit than the longest item is.
    needs = items.groupBy(F.least(F.size("tokens"), F.lit(min_tokens)).alias("n")).agg(F.max(F.size("tokens")).alias("longest")).collect()
    masks = _masks_for([r["n"] for r in needs], min_tokens, similarity)
    reach = max((r["longest"] for r in needs), default=0)
    hashes = materialize(
        items.mapInArrow(lambda b: _item_hashes(b, masks, min_tokens), "mask int, hash bigint, item_id bigint, at int"), "hashes"
    )
    filled = spark.sparkContext.broadcast(build(hashes.select("hash")))
    regions = materialize(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), "text").mapInArrow(
            lambda b: _regions(b, filled, masks, reach),
            "region bigint, doc_id bigint, start bigint, tokens array<bigint>, hits array<struct<mask:int,hash:bigint,at:int>>",
        ),
        "regions",
    )
    hits = regions.select("region", F.explode("hits").alias("h")).select("region", "h.mask", "h.hash", F.col("h.at").alias("doc_at"))
    pairs = (
        hits.join(hashes, ["mask", "hash"])
        .select("region", "item_id", (F.col("doc_at") - F.col("at")).alias("shift"))
        .distinct()
    )
    laid = (
        pairs.join(regions.select("region", "doc_id", "start", "tokens").dropDuplicates(["region"]), "region")
        .join(items.select("item_id", F.col("tokens").alias("item_tokens")), "item_id")
        .select("doc_id", "item_id", "shift", "start", "tokens", "item_tokens")
    )
    found = laid.mapInArrow(
        lambda b: _verified(b, min_tokens, similarity), "doc_id bigint, item_id bigint, matched bigint, item_tokens bigint, start bigint"
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"), F.min("start").alias("start")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap an item; an overlap depends on the text alone.

    Rows are named by a hash of their text. What is found is written first, so the
    planner knows its size and shuffles the documents only if it is large.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row"), "text")
    found = overlaps(keyed, benchmark, id_column="__key").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.select("__key", "__row").join(materialize(found, "overlapping"), "__key", "left_anti").select("__row.*")
