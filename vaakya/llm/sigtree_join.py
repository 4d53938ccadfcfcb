"""N-gram Jaccard join with signature trees.

What it computes: every document's set of distinct word shingles (three words by default); two
documents link when ``100 * |A & B| >= threshold * |A | B|``; each document gets the smallest
doc_id it can reach over links.

How:

1. One pass counts words, one makes the sets.  Equal sets are one *node*, so copies never meet each other.
2. Lists.  Shingles have one order for all sets: first those with the rarest word, by a table of
   fixed size that counts all words of all texts by hash, then by hash.  Linked sets of sizes a and b share
   ``threshold`` percent of each, so they share one of the first ``a - ceil(threshold * a / 100)
   + 1`` shingles of the one and of the other.  A node is listed under those: no link is ever
   missed, whatever the table says, and a passage that many documents share stands in few
   lists because its words are frequent.  A list is cut where sizes are too far apart, and lists
   of the same nodes are one list.  Whole sets are written once, and only those of pairs that
   trees leave are read again.
3. Signature trees.  In every list, nodes are arranged in a tree whose inner nodes hold the OR
   of the token bitmaps below and the range of sizes.  Two trees are traversed together; a pair
   of tree nodes is left as soon as sizes or bitmaps bound the overlap below the threshold, or
   all below is one component.  Surviving pairs are verified on their whole sets.
4. Rounds.  At first each node brings the surviving pair of the largest possible overlap with a
   node before it in its list, so a list of n nodes brings n - 1 pairs at most, and of long
   lists a node's first ones alone; verified pairs make components.  The last round brings
   every surviving pair that joins two components and was not verified before, in the first of
   the long lists that have both.

Lists of any length are handled: long ones are cut into blocks, and blocks are compared with
blocks of those nodes alone that are not in the list's largest component.

Null text, empty text and text of white space alone have no shingles and link with nothing.
Fewer words than a shingle: the whole sequence is the one shingle.  Repeated rows give one
result row each.  A row without a doc_id links like any other but never names a component: its
component_id is the smallest doc_id of its component, and null if no row there has one.  An
empty table gives no rows.  Columns other than doc_id and text are ignored, whatever their
names.  Shingles and nodes are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.llm import textbuf as tb
from vaakya.llm.components import connected_components
from vaakya.llm.lm_backoff import pack_sorted, unpack_sorted
from vaakya.llm.scratch import discard, materialise, tidy

SHINGLE_WORDS = 3
THRESHOLD = 90
#: Nodes of one list that a single task compares; longer lists are cut into blocks of this.
BLOCK = 1024
LEAF = 8
#: Bits of a bitmap for each shingle of a set.
BITS_EACH = 2
#: Lists of more nodes are long.  A node carries the names of the first CARRIED long lists it is
#: in, which tell a pair's first common one; rounds before the last look at the first FEW alone.
LONG, CARRIED, FEW = 32, 32, 2
#: Rounds in which a node brings one pair a list, before the one that brings all that are left.
FOREST_ROUNDS = 1
#: The table of counts has 2 ** SKETCH_BITS entries, is summed in SLICES parts, and keeps
#: STEPS levels for each doubling of a count in one byte an entry.
SKETCH_BITS, SLICES, STEPS = 23, 64, 5
#: Text that is hashed at once, about: a worker needs some forty times as much.
BLOCK_TEXT = 1 << 20
#: Copies of a text are left out within a task up to so many texts; elsewhere later on.
REMEMBERED = 1_000_000
#: Nodes up to which their hashes are sent to every task instead of joined (8 bytes each).
SENT = 1_000_000


def prefix_size(size: int, threshold: int) -> int:
    """Of how many shingles, the first of a set, a linked set has one at least among its own first."""
    return size + (-threshold * size // 100) + 1


def text_sets(column: pa.Array, n: int, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted shingle hashes of each text, and the level of each: that of its rarest word."""
    raw, offs = tb.buffers(column)
    raw = tb.LOWER[raw]
    starts, ends, first = tb.words(raw, offs)
    hashed = tb.word_hashes(raw, starts, ends)
    rare = levels[(hashed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    grams, least = tb.chain(hashed, n), rare[: max(len(rare) - n + 1, 0)].copy()
    for k in range(1, n):
        np.minimum(least, rare[k : k + len(least)], out=least)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= n:
            items, at = np.unique(grams[lo : hi - n + 1], return_index=True)
            yield items, least[lo : hi - n + 1][at]
        elif hi > lo:
            yield tb.mix(tb.chain(hashed[lo:hi], hi - lo)), rare[lo:hi].min(keepdims=True)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint8)


def node_of(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(items: np.ndarray) -> np.ndarray:
    """Bits of a set: their number is a power of two, at least BITS_EACH times the set's size."""
    bits = max(64, 1 << (BITS_EACH * max(len(items), 1) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(items >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags)


COUNTS = "slice int, part int, counts binary"
SETS = "doc_id long, n_shingles long, node long, items binary, usual array<long>, hot array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task by hash, in SLICES rows."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in tb.blocks(batches, size=BLOCK_TEXT):
        raw, offs = tb.buffers(batch.column("text"))
        raw = tb.LOWER[raw]
        starts, ends, _ = tb.words(raw, offs)
        np.add.at(counts, (tb.word_hashes(raw, starts, ends) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    if counts.any():
        packed = [_pack_counts(x) for x in counts.reshape(SLICES, -1)]
        columns = [pa.array(list(range(SLICES)), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["slice", "part", "counts"])
    del counts
    tb.trim()


def _describe(batches: Iterator[pa.RecordBatch], n: int, threshold: int, levels: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """A row a document, with the set and its first shingles where the task has not met the set before."""
    seen: set[int] = set()
    for batch in tb.blocks(batches, size=BLOCK_TEXT):
        rows: list[tuple] = []
        for doc_id, (items, level) in zip(batch.column("doc_id").to_pylist(), text_sets(batch.column("text"), n, levels)):
            node = node_of(items) if len(items) else None
            if node is None or node in seen:
                rows.append((doc_id, len(items), node, None, None, None))
                continue
            if len(seen) < REMEMBERED:
                seen.add(node)
            first = first_shingles(items, level, prefix_size(len(items), threshold))
            many = level[first] >= hot
            keys = items[first].view(np.int64)
            rows.append((doc_id, len(items), node, pack_sorted(items), keys[~many], keys[many]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SETS.split(", ")])
        del rows
        tb.trim()


def _pack_counts(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(_unpack_counts(x) for x in pdf["counts"])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [_pack_counts(total)]})


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """STEPS levels for each doubling: a byte holds any 45-bit count."""
    total = sum(_unpack_counts(x) for x in pdf["counts"])
    level = np.minimum(np.round(STEPS * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "levels": [level.tobytes()]})


def first_shingles(items: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of a sorted set, by level and then by hash."""
    if k >= len(items):
        return np.arange(len(items))
    cut = np.partition(level, k - 1)[k - 1]
    below = np.flatnonzero(level < cut)
    return np.concatenate([below, np.flatnonzero(level == cut)[: k - len(below)]])


def _runs(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The nodes of each list of two or more, from rows in order of list, size and node; the list's name is theirs."""

    def lists(key: np.ndarray, node: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # a node is listed once
        key, node, sizes = key[new], node[new], sizes[new]
        # of one key, sizes that are too far apart for a link are two lists
        apart = 100 * sizes[:-1] < threshold * sizes[1:]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | apart]))
        size = np.diff(np.append(start, len(key)))
        name = np.add.reduceat(tb.mix(node.view(np.uint64)), start)  # of the set, whatever its key
        keep = size > 1
        start, size, name = start[keep], size[keep], name[keep]
        name, once = np.unique(name, return_index=True)
        start, size = start[once], size[once]
        if not len(start):
            return None
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        members = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(node[at]))
        return pa.RecordBatch.from_arrays(
            [pa.array(name.view(np.int64)), pa.array(node[start]), members], ["list", "first", "members"]
        )

    key = node = size = np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column("list").to_numpy()])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        size = np.concatenate([size, batch.column("size").to_numpy()])
        if len(key) < 1 << 18:
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last list may go on
        if end and (out := lists(key[:end], node[:end], size[:end])) is not None:
            yield out
        key, node, size = key[end:], node[end:], size[end:]
    if len(key) and (out := lists(key, node, size)) is not None:
        yield out
    del key, node, size
    tb.trim()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [unpack_sorted(x.as_buffer()) for x in batch.column("items")]
        bits = [bitmap(x).tobytes() for x in sets]
        sizes = [len(x) for x in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["node", "size", "bits"]
        )


def linked(a: bytes, b: bytes, threshold: int) -> bool:
    x, y = unpack_sorted(a), unpack_sorted(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("items_u"), batch.column("items_v")
        ok = [linked(x.as_buffer(), y.as_buffer(), threshold) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))
        del left, right
        tb.trim()


# --- the tree -------------------------------------------------------------------------


class SignatureTree:
    """A binary tree over the rows of ``bits``: level by level, OR of bitmaps and size range.

    Rows are laid out so that similar bitmaps are neighbours (by size, then by bitmap), so
    the OR of a node stays close to its members' and the traversal can leave it early.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        self.levels = []
        own = np.bitwise_count(bits).sum(1, dtype=np.int64)
        # extra: elements a set has beyond its set bits (two shingles on one bit)
        level = {"or": bits, "lo": sizes, "hi": sizes, "extra": sizes - own, "clo": comps, "chi": comps}
        self.levels.append(level)
        while len(level["lo"]) > 1:
            step = LEAF if len(self.levels) == 1 else 2
            at = np.arange(0, len(level["lo"]), step)
            level = {
                "or": np.bitwise_or.reduceat(level["or"], at, axis=0),
                "lo": np.minimum.reduceat(level["lo"], at),
                "hi": np.maximum.reduceat(level["hi"], at),
                "extra": np.maximum.reduceat(level["extra"], at),
                "clo": np.minimum.reduceat(level["clo"], at),
                "chi": np.maximum.reduceat(level["chi"], at),
            }
            self.levels.append(level)


def _possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of tree nodes may hold a link between two components."""
    keep = ~((x["clo"][i] == x["chi"][i]) & (y["clo"][j] == y["chi"][j]) & (x["clo"][i] == y["clo"][j]))
    keep &= (100 * x["hi"][i] >= threshold * y["lo"][j]) & (100 * y["hi"][j] >= threshold * x["lo"][i])
    at = np.flatnonzero(keep)
    common = np.empty(len(at), np.int64)
    for lo in range(0, len(at), 4096):
        part = at[lo : lo + 4096]
        common[lo : lo + 4096] = np.bitwise_count(x["or"][i[part]] & y["or"][j[part]]).sum(1, dtype=np.int64)
    # an element in both sets sets a common bit; those that share a bit with another are counted by `extra`
    common += np.minimum(x["extra"][i[at]], y["extra"][j[at]])
    least = np.maximum(x["lo"][i[at]], 1) + np.maximum(y["lo"][j[at]], 1)
    keep[at] = common * (100 + threshold) >= threshold * least
    return keep


def traverse(x: SignatureTree, y: SignatureTree, threshold: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that the bounds don't exclude, by walking both trees down together."""
    level = max(len(x.levels), len(y.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        a, b = x.levels[min(level, len(x.levels) - 1)], y.levels[min(level, len(y.levels) - 1)]
        keep = _possible(a, i, b, j, threshold)
        i, j = i[keep], j[keep]
        if not level or not len(i):
            break
        step = LEAF if level == 1 else 2
        down_x, down_y = level < len(x.levels), level < len(y.levels)
        kids_i = np.arange(step) if down_x else np.zeros(1, np.int64)
        kids_j = np.arange(step) if down_y else np.zeros(1, np.int64)
        i = (i * (step if down_x else 1))[:, None, None] + kids_i[None, :, None]
        j = (j * (step if down_y else 1))[:, None, None] + kids_j[None, None, :]
        i, j = np.broadcast_arrays(i, j)
        i, j = i.ravel(), j.ravel()
        level -= 1
        ok = (i < len(x.levels[min(level, len(x.levels) - 1)]["lo"])) & (j < len(y.levels[min(level, len(y.levels) - 1)]["lo"]))
        if same:
            ok &= i <= j
        i, j = i[ok], j[ok]
    if same:
        ok = i < j
        i, j = i[ok], j[ok]
    return i, j


def fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width: wider ones are folded by OR of their halves."""
    width = min(len(m) for m in maps)
    out = np.zeros((len(maps), width), np.uint8)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0)
    return out


def best_earlier(tree: SignatureTree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs i < j, the one of each j with the largest possible share in common; its place."""
    leaves = tree.levels[0]
    common = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 4096):
        part = slice(lo, lo + 4096)
        common[part] = np.bitwise_count(leaves["or"][i[part]] & leaves["or"][j[part]]).sum(1, dtype=np.int64)
    common += np.minimum(leaves["extra"][i], leaves["extra"][j])
    share = common / np.maximum(leaves["lo"][i] + leaves["lo"][j], 1)
    order = np.lexsort((i, -share, j))
    return order[np.concatenate([[True], j[order][1:] != j[order][:-1]])] if len(order) else order


def met_before(name: int, longs: list[list[int]], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of members are together in a long list that comes before ``name``."""
    at = np.repeat(np.arange(len(longs)), [len(x) for x in longs])
    flat = np.array([x for row in longs for x in row], np.int64)
    at, flat = at[flat < name], flat[flat < name]
    earlier, place = np.unique(flat, return_inverse=True)
    flags = np.zeros((len(longs), len(earlier)), bool)
    flags[at, place] = True
    bits, out = np.packbits(flags, axis=1), np.zeros(len(u), bool)
    for lo in range(0, len(u), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        out[part] = (bits[u[part]] & bits[v[part]]).any(1)
    return out


def compare_list(
    name: int, nodes, side, sizes, comps, maps: list[bytes], longs: list[list[int]], threshold: int, forest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs within one list or block (all of side 0), or between two (sides 0 and 1).

    A pair that is together in an earlier long list is left to that one.
    """
    bits = fold(maps)
    order = np.lexsort((nodes, *bits[:, 7::-1].T, sizes))
    trees = []
    for s in (0, 1):
        at = order[side[order] == s]
        trees.append((nodes[at], comps[at], SignatureTree(bits[at], sizes[at], comps[at]), at) if len(at) else None)
    if trees[0] is None:
        return nodes[:0], nodes[:0]
    x, y = trees[0], trees[1] or trees[0]
    i, j = traverse(x[2], y[2], threshold, trees[1] is None)
    ok = x[1][i] != y[1][j]
    i, j = i[ok], j[ok]
    if any(longs):
        ok = ~met_before(name, longs, x[3][i], y[3][j])
        i, j = i[ok], j[ok]
    if forest and trees[1] is None:
        at = best_earlier(x[2], i, j)
        i, j = i[at], j[at]
    u, v = x[0][i], y[0][j]
    return np.minimum(u, v), np.maximum(u, v)


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, forest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members, names, lengths = batch.column("members"), batch.column("list").to_pylist(), batch.column("n").to_pylist()
        ends, flat = members.offsets.to_numpy(), members.values
        nodes, side, sizes, comps = (flat.field(k).to_numpy() for k in ("node", "side", "size", "comp"))
        maps = flat.field("bits")
        pairs = [(nodes[:0], nodes[:0])]
        longs = flat.field("longs")
        for name, n, lo, hi in zip(names, lengths, ends[:-1].tolist(), ends[1:].tolist()):
            part = slice(lo, hi)
            known = longs[lo:hi].to_pylist() if n > LONG else []
            pairs.append(compare_list(name, nodes[part], side[part], sizes[part], comps[part], maps[lo:hi].to_pylist(), known, threshold, forest))
        u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        del members, flat, maps, longs, pairs
        tb.trim()


# --- the join -------------------------------------------------------------------------


def word_levels(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(levels, hot): the level of each entry of the table, and from which one a list may be long."""
    counts = materialise(texts.mapInArrow(_count, COUNTS), "counts")
    some = counts.groupBy("slice", F.pmod("part", F.lit(1024)).alias("group")).applyInPandas(_sum_counts, "slice int, counts binary")
    rows = some.groupBy("slice").applyInPandas(_levels, "slice int, levels binary").collect()  # one byte an entry of the table
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8), 255
    levels = np.frombuffer(b"".join(bytes(r["levels"]) for r in sorted(rows, key=lambda r: r["slice"])), np.uint8)
    usual = 2.0 ** (float(np.median(levels)) / STEPS)
    return levels, min(255, int(np.ceil(STEPS * np.log2(max(2 * usual, usual + 4 * BLOCK)))))


def list_members(nodes: DataFrame, threshold: int) -> DataFrame:
    """list, node, n: the lists of two nodes or more, with their sizes."""
    usual = nodes.select(F.explode("usual").alias("list"), "node", F.col("n_shingles").alias("size"))
    usual = usual.repartition("list").sortWithinPartitions("list", "size", "node")
    usual = usual.mapInArrow(lambda it: _runs(it, threshold), "list long, first long, members array<long>").withColumn("n", F.size("members"))
    usual = usual.dropDuplicates(["list", "first", "n"]).select("list", F.explode("members").alias("node"), F.col("n").cast("long"))
    # what may be long is counted before it is dealt, and dealt by joins that split large keys
    long = nodes.select(F.explode("hot").alias("list"), "node").distinct()
    sizes = long.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(usual.union(long.join(sizes, "list").select("list", "node", "n")), "members")


def _blocks(members: DataFrame) -> DataFrame:
    """list, node, comp, p, q, side: rows of one (list, p, q) are compared by one task.

    A list of one block is compared with itself.  Of a longer one, each block (side 0) is
    compared with blocks (side 1) of the nodes outside the list's largest component.
    """
    cuts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    short = members.where(F.col("n") <= BLOCK)
    short = short.select("list", "n", "node", "comp", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"))
    long = members.where(F.col("n") > BLOCK).withColumn("cuts", cuts)
    sizes = long.groupBy("list", "n", "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("list", "n").agg(F.max(F.struct("m", "comp")).alias("top"))
    largest = largest.select("list", "n", F.col("top.comp").alias("major"), F.ceil((F.col("n") - F.col("top.m")) / F.lit(BLOCK)).cast("int").alias("few"))
    long = long.join(largest, ["list", "n"])
    deal = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    some = long.where("few > 0")
    home = some.select("list", "n", "node", "comp", deal(F.col("cuts"), 1).alias("p"), upto(F.col("few")).alias("q"), F.lit(0).alias("side"))
    others = some.where("comp != major")
    others = others.select("list", "n", "node", "comp", upto(F.col("cuts")).alias("p"), deal(F.col("few"), 2).alias("q"), F.lit(1).alias("side"))
    return short.union(home).union(others)


def _diagonal(members: DataFrame) -> DataFrame:
    """As :func:`_blocks`, but each block with itself and the list's first node alone."""
    cuts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("node", F.lit(1)), cuts).cast("int")).otherwise(F.lit(0))
    own = members.select("list", "n", "node", "comp", block.alias("p"))
    first = members.where(F.col("n") > BLOCK).groupBy("list", "n").agg(F.min(F.struct("node", "comp")).alias("x"))
    first = first.select("list", "n", "x.node", "x.comp", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("p"))
    again = first.where(F.col("p") != F.pmod(F.xxhash64("node", F.lit(1)), cuts).cast("int"))
    return own.union(again).select("*", F.lit(0).alias("q"), F.lit(0).alias("side"))


def linked_nodes(nodes: DataFrame, threshold: int) -> DataFrame:
    """node, component of the nodes that link with another, from rows of SETS; nodes may repeat."""
    spark = nodes.sparkSession
    sets = nodes.where("items is not null")
    members = list_members(sets, threshold)
    sets = sets.select("node", "items")
    tidy(spark)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Rows of ``sets`` whose node is wanted: whole sets are moved only where the list of nodes is long."""
        wanted = materialise(wanted.select("node").distinct(), "wanted")
        return sets.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "node", "left_semi")

    made = sets_of(members).mapInArrow(_bitmaps, "node long, size long, bits binary")
    # a node's own lists, no more than its first shingles
    longs = members.where(F.col("n") > LONG).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("list")), 1, CARRIED).alias("longs"))
    none = F.array().cast("array<bigint>")
    maps = made.dropDuplicates(["node"]).join(longs, "node", "left").withColumn("longs", F.coalesce("longs", none))
    maps = materialise(maps, "bitmaps")

    def candidates(rows: DataFrame, forest: bool) -> DataFrame:
        rows = rows.join(maps, "node")
        if forest:
            rows = rows.where((F.col("n") <= LONG) | F.array_contains(F.slice("longs", 1, FEW), F.col("list")))
        # two blocks at most: about 2 * BLOCK members in a row
        rows = rows.groupBy("list", "n", "p", "q").agg(F.collect_list(F.struct("side", "node", "comp", "size", "bits", "longs")).alias("members"))
        return rows.select("list", "n", "members").mapInArrow(lambda it: _compare(it, threshold, forest), "u long, v long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        whole = materialise(sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node"))).dropDuplicates(["node"]), "whole")
        both = (
            pairs.join(whole.select(F.col("node").alias("u"), F.col("items").alias("items_u")), "u")
            .join(whole.select(F.col("node").alias("v"), F.col("items").alias("items_v")), "v")
            .select("u", "v", "items_u", "items_v")
        )
        links = materialise(both.mapInArrow(lambda it: _verify(it, threshold), "u long, v long"), "links")
        discard(whole)
        return links

    links = tested = spark.createDataFrame([], "u long, v long")
    comp = spark.createDataFrame([], "node long, component long")
    for k in range(FOREST_ROUNDS + 1):  # one plan a round, however many lists there are
        last = k == FOREST_ROUNDS
        rows = members.join(comp, "node", "left").select("list", "n", "node", F.coalesce("component", "node").alias("comp"))
        if k:  # lists that still span two components; a list of two holds one pair, which may have been verified
            spans = rows.groupBy("list", "n").agg(
                F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("node").alias("u"), F.max("node").alias("v")
            ).where("a < b")
            spans = spans.where("n > 2").select("list", "n").union(spans.where("n = 2").join(tested, ["u", "v"], "left_anti").select("list", "n"))
            rows = materialise(rows.join(spans, ["list", "n"]).select("list", "n", "node", "comp"), "open")
            if rows.isEmpty():
                break
        pairs = candidates(_blocks(rows) if last else _diagonal(rows), not last)
        pairs = materialise(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        links, tested = links.union(verified(pairs)), tested.union(pairs)
        comp = materialise(connected_components(links), "comp")
        tidy(spark)
    discard(members)
    discard(maps)
    return comp


def shingle_components(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (see the module's text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels, hot = word_levels(texts.select("text"))
    sets = materialise(texts.mapInArrow(lambda it: _describe(it, n, threshold, levels, hot), SETS), "sets")
    rows = materialise(sets.select("doc_id", "n_shingles", "node"), "rows")
    comp = linked_nodes(sets, threshold)
    discard(sets)
    tidy(docs.sparkSession)
    # a component's id is the smallest doc_id of its nodes' documents
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = ids.join(comp, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_node = named.select("node", "comp").join(heads, "comp").select("node", "component_id")
    return rows.join(by_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
