"""Mixing sources to target weights over a splitting tree.

Sizes are words. Sources, in code-point order with null last, get the weights in
turn and share all words of the table by weight; a target stops at ``cap`` times
its source's size and the excess is shared again by weight until none is above.

A keyed hash permutes the documents of a source; its leading bits cut the
permutation into blocks. A source's words come from whole passes over its blocks
and one pass over the first blocks of the permutation, with one document cut so
that the source's words equal its target rounded down. Where that cut lies is
found by sums over ever longer prefixes of the hash, on narrow rows.

The (pass, block) units of all sources are dealt to output shards by a tree: each
node splits its shards in two halves and draws the left half's units from the
exact counts it holds, multivariate hypergeometric, so that the leaves' quotas
add up to what there is. Every leaf then takes the next units of each source's
shuffled order, which makes them disjoint, and orders its documents by a hash.

Only sums by source and block reach the driver: sources are a configured list,
and blocks number ``2**MAX_BLOCK_BITS`` a source at most.

Edge cases: null and empty texts have size zero and take nothing; a source of
size zero has target zero; null sources are one source; repeated rows count each;
rows equal in id and text lie at one place of the permutation, and if the cut
falls there they share its words evenly, rounded down; null ids are permuted by
their text; clashing extra columns aren't read; an empty table gives an empty
result. Equal input gives equal output, whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: A source has at least 2**BLOCK_BITS blocks, and more where a block would hold over an eighth of a shard.
BLOCK_BITS, MAX_BLOCK_BITS = 8, 14
SHARD_WORDS = 50_000_000
#: Small mixes, too, are dealt to several shards.
MIN_SHARDS = 16
#: Bits by which the prefix of the cut grows from one round to the next.
STEP_BITS = 14
SEED = 20240229
#: Rows of (source, block) up to which the plan is sent to every executor.
BROADCAST_ROWS = 500_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Target words of each source, given in order, for a mix as large as all of them."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if unit * weight[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split(counts: np.ndarray, capacity: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Quotas, a row for each shard: recursive halving of the exact counts."""
    if len(capacity) == 1:
        return counts[None, :]
    half = len(capacity) // 2
    left = rng.multivariate_hypergeometric(counts, int(capacity[:half].sum()), method="marginals")
    return np.concatenate([split(left, capacity[:half], rng), split(counts - left, capacity[half:], rng)])


@dataclass
class SourcePlan:
    """Whole passes, then every document whose key is below ``low``, and ``within`` words of those up to ``high``."""

    size: int
    target: float
    passes: int
    cut: int
    """First block of which the last pass doesn't take everything."""
    within: int
    """Words that the last pass takes between ``low`` and ``high``."""
    low: int = 0
    high: int = 0
    rows: int = 0
    """Documents between ``low`` and ``high``."""


def plan_source(blocks: np.ndarray, target: float) -> SourcePlan:
    size, goal = int(blocks.sum()), int(target + 1e-6)
    passes, rest = divmod(goal, size) if size else (0, 0)
    before = np.concatenate([[0], np.cumsum(blocks)])
    cut = int(np.searchsorted(before, rest, side="right")) - 1
    bits = len(blocks).bit_length() - 1
    low = (cut - (len(blocks) >> 1)) << (64 - bits)
    return SourcePlan(size, target, passes, cut, rest - int(before[cut]), low, low + (1 << (64 - bits)) - 1)


def deal(plans: list[SourcePlan], blocks: list[np.ndarray], shard_words: int, seed: int) -> dict[tuple[int, int], list[int]]:
    """Shard of each (source, block)'s passes, in order of the passes."""
    rng = np.random.default_rng(seed)
    units = []
    for s, p in enumerate(plans):
        held = np.flatnonzero(blocks[s])
        own = [(c, int(b)) for c in range(p.passes) for b in held]
        own += [(p.passes, int(b)) for b in held if b < p.cut or (b == p.cut and p.within)]
        units.append([own[i] for i in rng.permutation(len(own))])
    counts = np.array([len(u) for u in units], dtype=np.int64)
    total, words = int(counts.sum()), sum(int(p.target) for p in plans)
    shards = max(1, min(total, max(MIN_SHARDS, -(-words // shard_words))))
    capacity = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    quotas = split(counts, capacity, rng) if total else np.zeros((1, len(units)), dtype=np.int64)
    out: dict[tuple[int, int], list[int]] = {}
    for s, own in enumerate(units):
        shard = np.repeat(np.arange(len(quotas)), quotas[:, s])
        for (_, b), at in sorted(zip(own, shard.tolist(), strict=True)):
            out.setdefault((s, b), []).append(at)
    return out


def _prefix(bits: int) -> Column:
    return F.shiftright("key", 64 - bits)


def _find_cuts(sized: DataFrame, names: list, plans: list[SourcePlan], bits: int) -> None:
    """Narrow each plan's ``low`` to ``high`` until one document (or equal ones) lies between."""
    spark = sized.sparkSession
    open_ = {n: p for n, p in zip(names, plans, strict=True) if p.within}
    while open_ and bits < 64:
        longer = min(64, bits + STEP_BITS)
        at = spark.createDataFrame(
            [(name, unnamed, p.low >> (64 - bits)) for (unnamed, name), p in open_.items()], "source string, unnamed boolean, prefix bigint"
        )
        # As many rows as sources, and 2**STEP_BITS sums for each.
        found = (
            sized.withColumn("prefix", _prefix(bits))
            .join(F.broadcast(at), ["source", "unnamed", "prefix"])
            .groupBy("source", "unnamed", _prefix(longer).alias("next"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"))
            .collect()
        )
        by_source: dict = {}
        for r in sorted(found, key=lambda r: r["next"]):
            by_source.setdefault((r["unnamed"], r["source"]), []).append(r)
        for name, p in list(open_.items()):
            for r in by_source[name]:
                if p.within < r["words"]:
                    break
                p.within -= r["words"]
            else:
                raise AssertionError("a cut lies beyond its block")
            p.low = r["next"] << (64 - longer)
            p.high, p.rows = p.low + (1 << (64 - longer)) - 1, r["n"]
            if p.rows == 1 or not p.within:
                del open_[name]
        bits = longer


def _sized(docs: DataFrame, seed: int) -> dict[str, Column]:
    return {
        "source": F.coalesce(F.col("source"), F.lit("")),
        "unnamed": F.col("source").isNull(),
        "size": F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint"),
        "key": F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))),
    }


def _planned(docs: DataFrame, weights: tuple[float, ...], cap: int, shard_words: int, seed: int):
    """(narrow rows, plan by source and block, bits of a block)."""
    spark = docs.sparkSession
    own = _sized(docs, seed)
    sized = materialize(docs.select("doc_id", *[c.alias(k) for k, c in own.items()]), "sizes")
    most = sized.groupBy("source", "unnamed").agg(F.sum("size").alias("words")).agg(F.max("words")).first()[0] or 0
    bits = min(MAX_BLOCK_BITS, max(BLOCK_BITS, (8 * most // shard_words).bit_length()))
    block = (_prefix(bits) + F.lit(1 << (bits - 1))).cast("int")
    sums = sized.groupBy("source", "unnamed", block.alias("block")).agg(F.sum("size").alias("words")).collect()
    names = sorted({(r["unnamed"], r["source"]) for r in sums})
    place = {n: i for i, n in enumerate(names)}
    blocks = np.zeros((len(names), 1 << bits), dtype=np.int64)
    for r in sums:
        blocks[place[r["unnamed"], r["source"]], r["block"]] = r["words"]
    wanted = targets([int(b.sum()) for b in blocks], weights, cap)
    plans = [plan_source(b, t) for b, t in zip(blocks, wanted, strict=True)]
    _find_cuts(sized, names, plans, bits)
    dealt = deal(plans, blocks, shard_words, seed)
    table = [
        (name, unnamed, b, p.size, p.target, p.passes, p.low, p.high, p.within // max(1, p.rows), dealt.get((s, b), []))
        for s, ((unnamed, name), p) in enumerate(zip(names, plans, strict=True))
        for b in range(1 << bits)
    ]
    plan = spark.createDataFrame(
        table,
        "source string, unnamed boolean, block int, source_size bigint, target double, passes int, low bigint, high bigint, share bigint, shards array<int>",
    )
    return sized, F.broadcast(plan) if len(table) <= BROADCAST_ROWS else plan, block


def _draws() -> Column:
    """(pass, words, shard) of each time a document is drawn."""
    last = F.when(F.col("key") < F.col("low"), F.col("size")).when(F.col("key") <= F.col("high"), F.least("size", "share")).otherwise(F.lit(0))
    return F.filter(
        F.transform(
            "shards",
            lambda shard, i: F.struct(
                i.alias("pass"), F.when(i < F.col("passes"), F.col("size")).otherwise(last).cast("bigint").alias("words"), shard.alias("shard")
            ),
        ),
        lambda d: d.words > 0,
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, size, source_size, target, taken, draws.

    ``draws`` lists (pass, words, shard) of each time the document is drawn.
    """
    sized, plan, block = _planned(docs, weights, cap, shard_words, seed)
    joined = sized.withColumn("block", block).join(plan, ["source", "unnamed", "block"]).withColumn("draws", _draws())
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda acc, d: acc + d.words)
    return joined.select("doc_id", "key", "size", "source_size", "target", taken.alias("taken"), "draws")


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of a shard together, in the order of a hash; a shard may span files, so none is too large for a task."""
    at = F.xxhash64(F.lit(seed), "key", "pass")
    return rows.withColumn("at", at).repartitionByRange("shard", "at").sortWithinPartitions("shard", "at").drop("at", "key")


OWN = ("shard", "pass", "size", "source_size", "target", "taken")


def drawn(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS, seed: int = SEED
) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each time it is drawn, by shard and in the shard's order.

    The columns of ``OWN`` come along; ``taken`` is the words of this draw. A
    document that is cut keeps its first ``taken`` words, and n_chars follows.
    """
    _, plan, block = _planned(docs, weights, cap, shard_words, seed)
    own = _sized(docs, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in own.items()])
    joined = rows.withColumn("block", block).join(plan, ["source", "unnamed", "block"])
    each = joined.select("row", "key", "size", "source_size", "target", F.explode(_draws()).alias("d")).select(
        "row", "key", "size", "source_size", "target", "d.shard", "d.pass", F.col("d.words").alias("taken")
    )
    words = F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("taken").cast("int"))
    whole = F.col("taken") == F.col("size")
    laid = _shuffled(each.withColumn("__text", F.when(whole, F.col("row.text")).otherwise(F.array_join(words, ""))), seed)
    column = {
        "text": F.col("__text"),
        "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.char_length("__text").cast("bigint")) if "n_chars" in docs.columns else None,
    }
    return laid.select(*[column.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in OWN], *OWN)


def shards(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, doc_id, pass, words): each shard's documents together, shuffled by a hash."""
    rows = mixed.select("doc_id", "key", F.explode("draws").alias("d")).select("d.shard", "doc_id", "key", "d.pass", "d.words")
    return _shuffled(rows, seed)
