"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: ASCII lower case, words between ASCII white space, shingles of
``words`` words (repeats included), XXH64 with seed 42; a bit is 1 if more than
half of the hashes have it. Texts with fewer words are one shingle; texts
without words have fingerprint zero.

The index works on distinct fingerprints. A node is a mask and a pattern: all its
members agree on the masked bits. The free bits of a node are cut into
``radius + 1`` blocks; two members within ``radius`` bits agree on one block at
least, so they meet again in one child, and no link is lost. Nodes of more than
``leaf`` members go down a level; with few free bits left a node can't hold more
than ``leaf`` distinct fingerprints, so leaves are bounded at any input size. Within a
leaf the members are sorted by Gray rank, so that neighbours share bits; runs of
eight are factored into upper nodes that keep the bits all below them share,
and a search drops a whole run once the differences accumulated on the shared
bits pass the radius.

Leaves return a spanning forest of their links, which keeps what is reachable,
and never all pairs. Copies share a fingerprint and are one member.

Edge cases: a null text counts as empty; empty texts link to one another like
any other; a null id takes part and gets its group's least non-null id; repeated
rows are kept; columns with clashing names are not read; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import materialize

LEAF = 4096
FAN = 8
#: Shingle hashes whose bits are counted at once.
SLICE = 1 << 14


def shingles(text: bytes, words: int) -> Iterator[bytes]:
    found = text.lower().split()
    if len(found) < words:
        return iter([b" ".join(found)] if found else [])
    return map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles(text, words)), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of the hashes; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        part = np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, one row per input row."""

    def run(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for i in range(batch.num_rows):
                out[i] = majority(shingle_hashes(batch.column(1)[i].as_buffer().to_pybytes(), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    narrow = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    )
    return narrow.mapInArrow(run, "id bigint, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of distinct ``fps`` that differ in at most ``radius`` bits."""
    order = np.argsort(gray_rank(fps), kind="stable")
    codes = fps[order]
    both, any_ = [codes], [codes]
    while len(both[-1]) > FAN:
        starts = np.arange(0, len(both[-1]), FAN)
        both.append(np.bitwise_and.reduceat(both[-1], starts))
        any_.append(np.bitwise_or.reduceat(any_[-1], starts))
    shared = [~(a ^ o) for a, o in zip(both, any_, strict=True)]
    left, right = [], []
    for at in range(0, len(codes), 256):
        query = np.arange(at, min(at + 256, len(codes)))
        q = np.repeat(query, len(both[-1]))
        n = np.tile(np.arange(len(both[-1])), len(query))
        for level in range(len(both) - 1, -1, -1):
            apart = np.bitwise_count((codes[q] ^ both[level][n]) & shared[level][n])
            keep = apart <= radius
            # A pair is looked for once, from its later member.
            keep &= n * FAN**level < q
            q, n = q[keep], n[keep]
            if level:
                q = np.repeat(q, FAN)
                n = (n[:, None] * FAN + np.arange(FAN)).ravel()
                inside = n < len(both[level - 1])
                q, n = q[inside], n[inside]
        left.append(order[n])
        right.append(order[q])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each of n members' component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def child_masks(mask: int, radius: int, bits: int = 64) -> list[int]:
    """``mask`` plus each of radius + 1 blocks of its free bits, high bits first."""
    free = [b for b in range(bits - 1, -1, -1) if not mask >> b & 1]
    return [mask | sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(free), radius + 1) if len(block)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _leaf_links(batches, radius: int):
    for batch in batches:
        us, vs = [], []
        members = batch.column(0)
        for k in range(batch.num_rows):
            fps = np.sort(members[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
            i, j = near_pairs(fps, radius)
            if len(i):
                label = spanning(len(fps), i, j)
                hung = np.flatnonzero(label != np.arange(len(fps)))
                us.append(fps[hung])
                vs.append(fps[label[hung]])
        put = lambda x: pa.array((np.concatenate(x) if x else np.empty(0, np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([put(us), put(vs)], ["u", "v"])


def links(distinct: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """(u, v): a spanning set of the links of the distinct ``fp``, through the index."""
    masks = [0]
    rows = distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    found = None
    while True:
        table = {m: child_masks(m, radius) for m in masks}
        masks = sorted({c for cs in table.values() for c in cs})
        long = lambda x: F.lit(_signed(x)).cast("bigint")
        child = F.create_map(*[x for m, cs in table.items() for x in (long(m), F.array(*map(long, cs)))])
        rows = (
            rows.select("fp", F.explode(child[F.col("mask")]).alias("mask"))
            .distinct()
            .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"))
        )
        rows = materialize(rows, "nodes")
        counts = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n"))
        # A node's distinct members fit into the bits still free, so the last level has no large node.
        last = 1 << (64 - min(m.bit_count() for m in masks)) <= leaf
        large = None if last else materialize(counts.where(F.col("n") > leaf).select("mask", "pattern"), "large")
        done = last or large.isEmpty()
        leaves = rows if done else rows.join(large, ["mask", "pattern"], "left_anti")
        grouped = leaves.groupBy("mask", "pattern").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        part = grouped.select("fps").mapInArrow(lambda batches: _leaf_links(batches, radius), "u bigint, v bigint")
        found = part if found is None else found.union(part)
        if done:
            return found
        rows = rows.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_column: str = "doc_id") -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of fingerprints."""
    marked = materialize(fingerprints(docs, words, id_column), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    linked = materialize(linked.join(distinct, "fp"), "linked")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    of = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return marked.join(of, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts, the same one in every run.

    Rows are named by a hash of id and text. The lists of names that go, and of
    names that several rows share, are written first: the planner knows their size
    and shuffles the documents only if they are large.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row"), "text")
    groups = similar_groups(keyed, words, similarity, id_column="__key")
    named = groups.groupBy(F.col("id").alias("__key")).agg(F.count("*").alias("n"), F.first("component").alias("component"))
    named = materialize(named, "named")
    rows = keyed.select("__key", "__row").join(materialize(named.where("__key <> component").select("__key"), "going"), "__key", "left_anti")
    shared = materialize(named.where("__key = component and n > 1").select("__key"), "shared")
    # Of rows equal in id and text but not in other columns, the one with the least hash.
    one = F.min_by("__row", F.xxhash64(*[F.col(f"__row.`{c}`") for c in docs.columns])).alias("__row")
    again = rows.join(shared, "__key", "left_semi").groupBy("__key").agg(one).select("__row")
    return rows.join(shared, "__key", "left_anti").select("__row").union(again).select("__row.*")


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Groups by similarity: a long SimHash sketch proposes links, the shingle sets decide them.

#: Members that a node of unlike texts has on average; the length of the pieces follows from it.
MEMBERS = 256
PIECE_BITS = 10
#: Probability that two sets at the similarity share no piece.
MISSED = 2e-5
#: Sets of up to so many shingles meet by their least hashes, where no link is lost, instead of by pieces.
SHORT = 64
#: Members of a node that one task compares with each other; larger nodes are dealt to blocks.
NODE = 2048
#: Words of the sketch that go to the nodes, which propose; the sets decide.
SENT = 4
#: Shingle sets, and bytes of them, in a block that is verified with others of its cluster.
SET_ROWS, SET_BYTES = 512, 16 << 20


@dataclass(frozen=True)
class Layout:
    """Pieces of ``bits`` masked bits of a sketch of ``words`` 64-bit words; none lies across two words."""

    bits: int
    words: int

    @property
    def per_word(self) -> int:
        return 64 // self.bits

    @property
    def mixers(self) -> np.ndarray:
        return (np.arange(1, self.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def pieces(self, sketches: np.ndarray) -> np.ndarray:
        """The pieces of every row of ``sketches``, a column for each."""
        shifts = np.arange(self.per_word, dtype=np.uint64) * np.uint64(self.bits)
        cut = sketches[:, :, None] >> shifts & np.uint64((1 << self.bits) - 1)
        return cut.reshape(len(sketches), -1).astype(np.int64)


def layout_for(rows: int, similarity: float) -> Layout:
    """Longer pieces, and more of them, for larger tables: unlike texts make nodes of ``MEMBERS`` at any size."""
    bits = max(PIECE_BITS, int(np.ceil(np.log2(max(1, rows) / MEMBERS))))
    same = min((1 - _apart(similarity)) ** bits, 0.99)
    pieces = int(np.ceil(np.log(MISSED) / np.log1p(-same)))
    return Layout(bits, max(SENT, -(-pieces // (64 // bits))))


def _apart(similarity: float) -> float:
    """Probability that a bit differs between two sets of equal size at this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def sketch_radius(similarity: float, bits: int, short: bool) -> int:
    """Differing bits that sets of this similarity have in ``bits`` bits, and some standard deviations.

    Two sets of equal size at Jaccard similarity s have the cosine 2s / (1 + s); a
    bit differs with the probability of their angle over pi. Ties make it up to a
    quarter more in sets of a few shingles (3/16 for four and five, at 0.8).
    """
    p = (1.25 if short else 1.06) * _apart(similarity)
    return int(bits * p + (5 if short else 4) * np.sqrt(bits * p * (1 - p)))


def sketch(hashes: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) that are set in more than half of the hashes, under every mixer."""
    counts = np.zeros(64 * len(mixers), dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            x = hashes[at : at + 1024, None] * mixers[None, :]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return (counts * 2 > len(hashes)).astype(np.uint8)


def meeting_pieces(hashes: np.ndarray, pieces: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the nodes of a set with these sorted distinct hashes and pieces.

    Of two sets at ``similarity`` both are up to SHORT, or both above its share.
    Short ones share one of their least hashes: more than the others can't differ.
    """
    n, out = len(hashes), []
    if 0 < n <= SHORT:
        out.append(hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1].view(np.int64) | np.int64(-1 << 63))
    if n > int(SHORT * similarity) or not n:
        out.append(pieces | np.arange(len(pieces)) << 48)
    return np.concatenate(out)


def _narrow(docs: DataFrame, id_column: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(text).alias("raw")
    )


def _node(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))


def sketches(docs: DataFrame, layout: Layout, words: int, id_column: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """(id, raw, node, size, sketch, pieces) of the distinct shingles; node names the sequence of words, equal sequences share one."""
    mixers = layout.mixers

    def run(batches):
        for batch in batches:
            out = {"node": [], "size": [], "sketch": [], "pieces": []}
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer().to_pybytes()
                hashes = np.unique(shingle_hashes(text, words))
                packed = np.packbits(sketch(hashes, mixers), bitorder="little")
                out["node"].append(_node(text))
                out["size"].append(len(hashes))
                out["sketch"].append(packed.tobytes())
                out["pieces"].append(meeting_pieces(hashes, layout.pieces(packed.view("<u8")[None, :])[0], similarity))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.array(out["node"], dtype=np.uint64).view(np.int64)),
                    pa.array(out["size"], pa.int32()),
                    pa.array(out["sketch"], pa.binary()),
                    pa.array(out["pieces"], pa.list_(pa.int64())),
                ],
                ["id", "raw", *out],
            )

    return _narrow(docs, id_column).mapInArrow(
        run, "id bigint, raw bigint, node bigint, size int, sketch binary, pieces array<bigint>"
    )


def similar_pairs(
    sketches_: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a member of a, one of b) within the radius whose sets' sizes allow the similarity, and their differing bits.

    Members are sorted by size band, then by the Gray rank of the sketch's first
    word, so that neighbours share bits. Runs of eight of b are upper nodes with
    the bits that all below them share; a run goes as a whole once the differences
    on its shared bits pass what the first two words may differ in. Differences of
    the rest are accumulated word by word. Pairs come by 256 members of a at a time.
    """
    if not len(a) or not len(b):
        return
    bands = np.floor(np.log(np.maximum(sizes, 1)) / -np.log(min(similarity, 0.999)) * (1 - 1e-9))
    rank = gray_rank(sketches_[:, 0])
    a, b = (x[np.lexsort((rank[x], bands[x]))] for x in (a, b))
    b_bands = bands[b]
    width = 64 * sketches_.shape[1]
    wide, narrow = sketch_radius(similarity, width, True), sketch_radius(similarity, width, False)
    heads = np.arange(0, len(b), FAN)
    both = np.bitwise_and.reduceat(sketches_[b, :2], heads)
    shared = ~(both ^ np.bitwise_or.reduceat(sketches_[b, :2], heads))
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        low = np.searchsorted(b_bands, bands[rows[0]] - 1)
        high = np.searchsorted(b_bands, bands[rows[-1]] + 1, side="right")
        if low == high:
            continue
        short = similarity * sizes[rows].min() <= SHORT
        first = sketch_radius(similarity, 128, bool(short))
        part = sketches_[rows]
        runs = np.arange(low // FAN, (high - 1) // FAN + 1)
        apart = np.bitwise_count((part[:, None, 0] ^ both[None, runs, 0]) & shared[None, runs, 0])
        apart += np.bitwise_count((part[:, None, 1] ^ both[None, runs, 1]) & shared[None, runs, 1])
        alive = runs[(apart <= first).any(axis=0)]
        columns = (alive[:, None] * FAN + np.arange(FAN)).ravel()
        columns = b[columns[(columns >= low) & (columns < high)]]
        other = sketches_[columns]
        apart = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0])
        apart += np.bitwise_count(part[:, None, 1] ^ other[None, :, 1])
        i, j = np.nonzero(apart <= first)
        total = apart[i, j].astype(np.int64)
        for w in range(2, sketches_.shape[1]):
            total = total + np.bitwise_count(part[i, w] ^ other[j, w])
            keep = total <= wide
            i, j, total = i[keep], j[keep], total[keep]
        i, j = rows[i], columns[j]
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        keep = (small >= similarity * large - 1e-6) & (total <= np.where(small <= SHORT, wide, narrow)) & (i != j)
        yield i[keep], j[keep], total[keep]


def _groups(batches, keys: int) -> Iterator[list]:
    """Columns of each run of rows with equal leading ``keys`` columns; numbers, and bytes as rows of words, as arrays."""

    def read(column):
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)
        if pa.types.is_list(column.type):
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            out = np.empty(len(column), dtype=object)
            out[:] = np.split(flat, ends[:-1]) if len(column) else []
            return out
        return column.to_numpy(zero_copy_only=False).astype(np.int64)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [read(c) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = np.zeros(len(rows[0]) - 1, dtype=bool)
        for k in range(keys):
            new |= np.diff(rows[k]) != 0
        cut = np.flatnonzero(new) + 1
        last = cut[-1] if len(cut) else 0
        for group in np.split(np.arange(last), cut[:-1]) if last else []:
            yield [x[group] for x in rows]
        held = [x[last:] for x in rows]
    if held is not None and len(held[0]):
        yield held


def _links(found: list) -> pa.RecordBatch:
    put = lambda k: pa.array(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([put(0), put(1)], ["u", "v"])


def _in_turn(pairs, chunk: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of many groups, in batches."""
    found, n = [], 0
    for u, v in pairs:
        found.append((u, v))
        n += len(u)
        if n >= chunk:
            yield _links(found)
            found, n = [], 0
    yield _links(found)


def _node_links(batches, similarity: float):
    """Rows sorted by (piece, block): a spanning forest of the candidates among a block's members.

    Rows are (piece, block, own, minor, node, root, size, sketch). Those that belong
    to the block meet those that aren't of the node's largest group; what a root
    already connects needs no link, so links join roots.
    """

    def forest(rows):
        _, _, own, minor, _, root, size, words = rows
        roots, at = np.unique(root, return_inverse=True)
        label = np.arange(len(roots))
        if len(roots) > 1:
            for i, j, _ in similar_pairs(words, size, np.flatnonzero(own), np.flatnonzero(minor), similarity):
                p, q = label[at[i]], label[at[j]]
                label = spanning(len(roots), p[p != q], q[p != q])[label]
        hung = np.flatnonzero(label != np.arange(len(roots)))
        return roots[hung], roots[label[hung]]

    return _in_turn(forest(rows) for rows in _groups(batches, 2))


_EDGES = "u bigint, v bigint"


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    dealt = rows.select("piece", "block", "own", "minor", "node", "root", "size", "sketch").repartition("piece", "block")
    return dealt.sortWithinPartitions("piece", "block").mapInArrow(lambda b: _node_links(b, similarity), _EDGES)


def clusters(distinct: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of members that have a candidate: components of the graph of candidates.

    A large node's members are first compared within blocks. Those that aren't
    connected by then, anywhere, meet in a second round: the node's largest group
    stays in its blocks and all others go to each of them, so that a node ruled by
    one group costs no pairs within it.
    """
    narrow = distinct.select("node", "size", F.substring("sketch", 1, 8 * SENT).alias("sketch"), F.explode("pieces").alias("piece"))
    large = narrow.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") > NODE)
    large = materialize(large.select("piece", F.ceil(F.col("n") / NODE).cast("int").alias("blocks")), "large")
    home = F.pmod(F.xxhash64("node", "piece"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = narrow.join(large, "piece", "left").select(
        "*", home.alias("block"), F.col("node").alias("root"), F.lit(1).cast("tinyint").alias("own"), F.lit(1).cast("tinyint").alias("minor")
    )
    links = materialize(_compared(dealt, similarity).distinct(), "candidates")
    roots = components(links)
    if large.isEmpty():
        return roots
    rows = narrow.join(large, "piece").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialize(rows, "open")
    held = rows.groupBy("piece", "root").agg(F.count("*").alias("n")).groupBy("piece")
    held = held.agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where(F.col("n") > F.col("most.n"))
    held = materialize(held.select("piece", F.col("most.root").alias("largest")), "held")
    placed = rows.join(held, "piece").withColumn("home", home)
    minor = F.col("root") != F.col("largest")
    everywhere = F.when(minor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    again = placed.select("*", F.explode(everywhere).alias("block"), minor.cast("tinyint").alias("minor"))
    again = again.withColumn("own", (F.col("block") == F.col("home")).cast("tinyint"))
    return components(links.union(_compared(again, similarity)).distinct())


def _shingle_sets(batches, words: int):
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column(0)]
        node = pa.array(np.array([_node(t) for t in texts], dtype=np.uint64).view(np.int64))
        sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([node, pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(batches, similarity: float):
    """Rows (cluster, p, q, block, node, size, sketch, shingles) sorted by the first three: a spanning forest of the
    links between the blocks p and q that the sets decide.

    The nearest of 256 members' candidates come first, and pairs that are connected by then are not looked at.
    """

    def forest(rows):
        _, p, q, block, node, size, words, sets = rows
        a, b = np.flatnonzero(block == p), np.flatnonzero(block == q)
        sets = [np.sort(x) for x in sets]
        label, u, v = np.arange(len(node)), [], []
        for i, j, bits in similar_pairs(words, size, a, b, similarity):
            new = label[i] != label[j]
            i, j, bits = i[new], j[new], bits[new]
            order = np.lexsort((j, i, bits))
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if label[x] != label[y] and jaccard_reaches(sets[x], sets[y], similarity):
                    label[label == label[y]] = label[x]
                    u.append(node[x])
                    v.append(node[y])
        return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)

    return _in_turn(forest(rows) for rows in _groups(batches, 3))


def verified(clustered: DataFrame, docs: DataFrame, marked: DataFrame, distinct: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links between members of a cluster (node, root) whose sets of distinct shingles have the similarity.

    They connect what all such links would connect. Only texts of clustered nodes
    are read. A cluster's sets are dealt to blocks, and every pair of its blocks
    meets in a task; no pair of members becomes a row.
    """
    clustered = materialize(clustered, "clusters")
    wanted = marked.join(clustered.select("node"), "node", "left_semi").groupBy("node").agg(F.min("raw").alias("raw"))
    wanted = materialize(wanted.select("raw").distinct(), "wanted")
    texts = _narrow(docs, docs.columns[0]).join(wanted, "raw", "left_semi").dropDuplicates(["raw"]).select("text")
    sets = texts.mapInArrow(lambda b: _shingle_sets(b, words), "node bigint, shingles array<bigint>")
    held = distinct.select("node", "size", "sketch").join(clustered, "node").join(sets, "node")
    held = materialize(held.select(F.col("root").alias("cluster"), "node", "size", "sketch", "shingles"), "sets")
    blocks = F.greatest(F.ceil(F.count("*") / SET_ROWS), F.ceil(F.sum("size") * 8 / SET_BYTES)).cast("int")
    large = materialize(held.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    placed = held.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select(
        "cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "size", "sketch", "shingles"
    )
    dealt = dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    return dealt.mapInArrow(lambda b: _verified(b, similarity), _EDGES)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """(id, component): groups of texts linked by a Jaccard similarity of their shingle sets of ``similarity`` or more.

    Every piece of a sketch is an upper node, the masked pattern that its members
    share. Members of a node are compared in Gray order, by runs that share bits;
    what is within the radius is connected to clusters, and inside a cluster the
    shingle sets decide every link. Two texts at the similarity meet in some node
    with probability 1 - ``MISSED``, short ones always.
    """
    layout = layout_for(docs.count(), similarity)
    marked = materialize(sketches(docs, layout, words, id_column, similarity), "sketches")
    named = marked.groupBy("node").agg(F.min("id").alias("least"))
    named = materialize(named, "named")
    distinct = materialize(marked.select("node", "size", "sketch", "pieces").dropDuplicates(["node"]), "distinct")
    links = materialize(verified(clusters(distinct, similarity), docs, marked, distinct, words, similarity), "links")
    linked = components(links).select(F.col("node"), "root")
    linked = materialize(linked.join(named, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = named.join(linked.join(least, "root").select("node", "component"), "node", "left").select(
        "node", F.coalesce("component", "least").alias("component")
    )
    return marked.select("id", "node").join(of, "node").select("id", "component")
