"""Packing by column generation for the cutting-stock problem.

Every document's ids (and one id that ends it) are cut at multiples of the sequence length;
what is left over, 1 to 2047 ids, is one more piece.  Whole pieces fill sequences of their
own.  The rest is a cutting-stock problem over the histogram of lengths, which has at most
2047 entries whatever the corpus holds: a linear program over patterns (multisets of lengths
that fit a sequence) is improved by columns that a knapsack dynamic program prices until a
bound proves that more can't help, its solution is rounded, and the pieces that rounding
leaves are a smaller histogram with a program of its own, until none is left.  Pieces are
ranked within their length, and a rank tells its sequence and offset, so assignment is a
lookup and no piece moves.

Ranks are given without a global sort: each task counts its own pieces by length while it
makes them, and offsets of tasks are running sums over (task, length) counts.

Null text is empty and gives the one end id.  Repeated doc_ids are documents of their own.
An empty table packs into no sequence.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaakya.llm import textbuf as tb
from vaakya.llm.memo import Memo
from vaakya.llm.scratch import materialise
from vaakya.llm.worker import once

SEQUENCE = 2048
END_ID = 1
#: The program is solved when its value is proven to be within this share of its least.
GAP = 1e-4
#: Share of prices by length in the first prices; updates of the inverse before it is computed
#: anew; the least pivot, as a share of the largest entry of its column.
STEADY, REFACTOR, PIVOT = 0.9, 100, 1e-3
#: Words of which a task remembers the ids before it starts anew.
CACHE_WORDS = 400_000

# Words of a text of Latin-1 characters, as the vocabulary's own pre-tokenizer finds them
# after lower-casing.  Fixed values: its contractions, and letters, numbers and white space
# among U+0000 to U+00FF.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+".encode("latin-1")
)
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))

# Byte-level vocabularies write a byte that prints as itself and each other byte as the next
# code point from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class Encoder:
    """ids of whole texts, remembering the ids of words.

    Texts of Latin-1 characters are split here and only words not met before reach the
    library, all in one call; other texts, and texts that may name special tokens, go to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = Memo()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        """Ids of words from the library's model, past its bookkeeping of offsets."""
        merge, ids, lengths = self.library.model.tokenize, [], []
        for word in new:
            # the model reads bytes as characters; letters and digits of ASCII stand for themselves
            plain = word.isalnum() and word.isascii()
            text = word.decode() if plain else word.decode("latin-1").encode().decode("latin-1").translate(_BYTES)
            found = merge(text)
            ids += [t.id for t in found]
            lengths.append(len(found))
        self.memo.add(new, np.array(ids, np.uint32), np.array(lengths, np.int64))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.memo) > CACHE_WORDS:
            self.memo = Memo()
        split: list[list[bytes] | None] = []
        for text in texts:
            try:
                plain = (text or "").encode("latin-1")
                split.append(None if b"<|" in plain else _WORD.findall(plain.translate(_LOWER)))
            except UnicodeEncodeError:
                split.append(None)
        if new := set().union(*filter(None, split)).difference(self.memo.index):
            self.learn(list(new))
        for text, words in zip(texts, split):
            yield self.whole(text) if words is None else self.memo.gather(words)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, sequence: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part = once("encoder", path, lambda: Encoder(path)), TaskContext.get().partitionId()
    counts = np.zeros(sequence + 1, np.int64)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"]
    for batch in tb.blocks(batches):
        out: list[tuple] = []
        texts = batch.column("text").to_pylist()
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), sequence):
                piece = ids[start : start + sequence]
                n = len(piece)
                out.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, int(counts[n])))
                counts[n] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    tb.trim()


# --- the plan, on the histogram of lengths --------------------------------------------


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, took): the most worth that each capacity up to ``capacity`` holds, and the length put there last."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fitting[c]:
            gain = best[c - lengths[:n]] + worth[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k + 1
    return best, took


def filling(took: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length the table of :func:`knapsack` puts into ``capacity``."""
    column, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if k := int(took[c]):
            column[k - 1] += 1
            c -= int(lengths[k - 1])
        else:
            c -= 1
    return column


def fullest(lengths: list[int], counts: list[int], space: int) -> dict[int, int]:
    """Positions in ``lengths`` (falling) and how many of each fill ``space`` as far as ``counts`` lets them.

    The knapsack at prices in proportion to length: sums that can be reached are bits of one
    number, and the stages before it tell which lengths a sum is made of, the longest first.
    """
    mask, reach, stages = (1 << (space + 1)) - 1, 1, []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        if length > space:
            continue
        have, group = min(count, space // length), 1
        while have:  # groups of 1, 2, 4, ... make up every number
            n = min(group, have)
            stages.append((k, n, reach))
            reach |= (reach << (n * length)) & mask
            have, group = have - n, 2 * group
        if reach >> space:
            break
    out: dict[int, int] = {}
    c = reach.bit_length() - 1
    for k, n, before in reversed(stages):
        if not before >> c & 1:
            out[k] = out.get(k, 0) + n
            c -= n * lengths[k]
    return out


def first_columns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from: as many columns as lengths, each priced at lengths, the longest left in each.

    A column is used until one of its lengths is met; the next ones do without it.  So the
    columns are a triangular matrix and their times meet the demand exactly.
    """
    m = len(lengths)
    patterns, times = np.zeros((m, m), np.int64), np.zeros(m)
    left, open_ = demand.astype(float), list(range(m - 1, -1, -1))
    for row in range(m):
        rest = [int(lengths[k]) for k in open_]
        most = [max(1, int(left[k])) for k in open_]
        most[0] -= 1
        pattern = fullest(rest, most, capacity - rest[0])
        pattern[0] = pattern.get(0, 0) + 1
        held = np.array([open_[j] for j in pattern])
        each = np.array(list(pattern.values()))
        ratio = left[held] / each
        done = int(held[ratio.argmin()])
        times[row] = ratio.min()
        patterns[row, held] = each
        left[held] = np.maximum(left[held] - times[row] * each, 0)
        left[done] = 0
        open_.remove(done)
    return patterns, times


def linear_program(
    lengths: np.ndarray, demand: np.ndarray, capacity: int, most: int | None = None, gap: float = GAP
) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, times, bound): a basis of the program that meets ``demand``, and a lower bound of its value.

    Columns are added until none is worth more than it costs or lowers the value, or the value
    is proven to be within a share ``gap`` of the bound, or to round to the same number of
    sequences.  A knapsack prices each length's best column at once, at prices between the
    program's own and those in proportion to length, which keep columns full while the
    program's prices still swing; its own alone decide whether a column enters, and when no
    column does they are priced alone.
    """
    m = len(lengths)
    patterns, times = first_columns(lengths, demand, capacity)
    natural = lengths / capacity
    bound = float(demand @ natural)
    inverse = np.linalg.inv(patterns.T.astype(float))
    duals, steady, columns, stale = inverse.sum(0), STEADY, 0, 0
    while most is None or columns < most:
        value = float(times.sum())
        if value - bound <= gap * bound or np.ceil(value - 1e-6) <= np.ceil(bound - 1e-6):
            break
        prices = steady * natural + (1 - steady) * np.maximum(duals, 0)
        best, took = knapsack(lengths, prices, capacity)
        bound = max(bound, float(demand @ prices) / max(float(best[capacity]), 1e-12))  # prices over the best column are dual
        entered = 0
        for k in np.argsort(natural - duals, kind="stable"):
            column = filling(took, lengths, capacity - int(lengths[k]))
            column[k] += 1
            held = np.flatnonzero(column)
            gain = float(duals[held] @ column[held]) - 1
            if gain <= 1e-9:
                continue
            direction = inverse[:, held] @ column[held].astype(float)
            rows = np.flatnonzero(direction > 1e-7)
            if not len(rows):
                continue
            ratio = times[rows] / direction[rows]
            ties = rows[ratio <= ratio.min() + 1e-12]
            r = int(ties[direction[ties].argmax()])
            if direction[r] < PIVOT * np.abs(direction).max():
                continue  # so small a pivot would lose the digits of the others
            step = times[r] / direction[r]
            times = np.maximum(times - step * direction, 0)
            times[r] = step
            pivot, near = inverse[r] / direction[r], np.flatnonzero(direction)
            inverse[near] -= np.outer(direction[near], pivot)
            inverse[r] = pivot
            duals = duals - gain * pivot
            patterns[r] = column
            entered, columns, stale = entered + 1, columns + 1, stale + 1
            if stale >= REFACTOR:  # rounding errors of updates don't add up
                inverse, stale = np.linalg.inv(patterns.T.astype(float)), 0
                times, duals = np.maximum(inverse @ demand, 0), inverse.sum(0)
            if columns == most:
                break
        if not entered or times.sum() > value - 1e-6:
            if not steady:
                break
            steady = steady / 2 if steady > 0.05 else 0.0
    return patterns, times, bound


def plan(histogram: dict[int, int], capacity: int = SEQUENCE, most: int | None = None) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: patterns of lengths that together hold every piece exactly once.

    A program's patterns are used as often as their times say, rounded down, and then once
    more each, the largest remainder first, where all their pieces are left.  What remains is
    a smaller histogram with a program of its own, until nothing does.  The one pattern that
    a round may need to go on is its most used one without the pieces that are gone, filled
    up from what is left.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def use(lengths: np.ndarray, column: np.ndarray, n: int) -> None:
        left[lengths] -= n * column
        held = np.flatnonzero(column)
        out.append(({int(lengths[k]): int(column[k]) for k in held}, n))

    while left.any():
        lengths = np.flatnonzero(left)
        patterns, times, _ = linear_program(lengths, left[lengths].astype(float), capacity, most)
        placed = 0
        for r, n in enumerate(np.floor(times + 1e-6).astype(np.int64)):
            held = patterns[r] > 0
            n = min(int(n), int((left[lengths[held]] // patterns[r][held]).min()))
            if n > 0:
                use(lengths, patterns[r], n)
                placed += n
        for r in np.argsort(np.floor(times + 1e-6) - times, kind="stable"):
            if times[r] > 1e-6 and (left[lengths] >= patterns[r]).all():
                use(lengths, patterns[r], 1)
                placed += 1
        if not placed:
            column = np.minimum(patterns[times.argmax()], left[lengths])
            rest = left[lengths] - column
            at = np.flatnonzero(rest)[::-1]
            more = fullest(lengths[at].tolist(), rest[at].tolist(), capacity - int(column @ lengths))
            for j, n in more.items():
                column[at[j]] += n
            use(lengths, column, 1)
    return out


def intervals(patterns: list[tuple[dict[int, int], int]], capacity: int = SEQUENCE) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: the first rank, the sequences and the offset it goes to."""
    cursor, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, n in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            a = pattern[length]
            rows.append((length, int(cursor[length]), base, a, offset))
            cursor[length] += a * n
            offset += a * length
        base += n
    rows.sort()
    names = ("length", "rank", "base", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def _place(batches: Iterator[pa.RecordBatch], runs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    # ranks of one length fit 44 bits; length and rank together order the runs
    keys = (runs["length"] << 44) | runs["rank"]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("before").to_numpy() + batch.column("local_rank").to_numpy()
        at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
        inside = rank - runs["rank"][at]
        each = np.maximum(runs["each"][at], 1)
        sequence = runs["base"][at] + inside // each
        offset = runs["offset"][at] + inside % each * length
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
        )


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, most: int | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long"
    pieces = materialise(texts.mapInArrow(lambda it: _pieces(it, tokenizer, sequence, end_id), made), "pieces")
    counts = pieces.groupBy("part", "length").count()
    # one row a length: at most ``sequence`` of them
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = intervals(plan(histogram, sequence, most), sequence)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, ["part", "length"]).mapInArrow(lambda it: _place(it, runs), SCHEMA)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
