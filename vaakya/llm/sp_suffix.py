"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut into chunks (spaces and the characters after them) that no piece of
the vocabulary crosses; chunks not met before are concatenated and indexed by a suffix array
as deep as the longest piece.  Every piece is binary-searched for its range of suffixes, and
the ranges are edges from a start to an end.  Edges are sorted by position and relaxed.

The vocabulary is a byte-pair one, where a best path by summed scores is not what the
reference library returns.  Relaxing therefore means: of all edges that join exactly two
present symbols, each chunk takes the best (the higher score, then the leftmost) until none
is left.  All chunks of a batch take their steps together; a very long chunk uses a heap.
Characters without a piece become their UTF-8 bytes.

Null and empty texts have no ids and decode to an empty text.  Repeated rows are encoded
alike.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.llm import textbuf as tb
from vaakya.llm.memo import Memo

SPACE = "▁"
#: Chunks a task remembers before it starts anew; characters indexed together, about.
CACHE_CHUNKS = 300_000
INDEX_CHARS = 1 << 20
#: A chunk longer than this is relaxed by a heap.
LONG = 256
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` code points, by doubling."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
    n, width = len(points), 1
    order = np.argsort(rank)
    while width < depth:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[-1] == rank.max() and width > 1:
            break
        rank[order] = new
        width *= 2
    return order


class Vocabulary:
    """Pieces of a byte-pair model with byte fallback, from its file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        size = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        self.bytes_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.raw = [b""] * size
        for k in plain:
            self.raw[k] = pieces[k].encode()
        for b in range(256):
            self.raw[int(self.bytes_id[b])] = bytes([b])
        self.id_of = {pieces[k]: k for k in plain}
        longer = sorted((k for k in plain if len(pieces[k]) > 1), key=lambda k: pieces[k])
        crossing = [k for k in longer if SPACE in pieces[k].lstrip(SPACE)]
        if crossing:
            raise ValueError("pieces that span a space inside are not supported")
        self.depth = max([len(pieces[k]) for k in longer], default=1)
        # scores as ranks: 0 is the best, equal scores share a rank
        scores = np.array([model.get_score(k) for k in longer], np.float64)
        self.piece_rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.piece_id = np.array(longer, np.int64)
        self.piece_length = np.array([len(pieces[k]) for k in longer], np.int64)
        # code points plus one, so 0 can end a chunk; the bound above a piece ends in the next point
        points = np.zeros((len(longer), self.depth), np.uint32)
        for row, k in enumerate(longer):
            points[row, : len(pieces[k])] = np.frombuffer(pieces[k].encode("utf-32-le"), np.uint32) + 1
        above = points.copy()
        above[np.arange(len(longer)), self.piece_length - 1] += 1
        self.low, self.high = _as_text(points), _as_text(above)

    # -- edges

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece row) of every occurrence of a piece of two or more characters, by start."""
        order = suffix_array(points, self.depth)
        padded = np.concatenate([points, np.zeros(self.depth, points.dtype)])
        heads = _as_text(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order])
        lo, hi = np.searchsorted(heads, self.low), np.searchsorted(heads, self.high)
        counts = hi - lo
        rows = np.repeat(np.arange(len(counts)), counts)
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(len(rows))
        start = order[at]
        by = np.argsort(start)
        start, rows = start[by], rows[by]
        return start, start + self.piece_length[rows], rows

    # -- relaxing

    def symbols(self, points: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, piece): which places begin a symbol, and the piece row of each that was joined, else -1.

        ``points`` are chunks, each followed by a 0; ``chunk`` numbers the chunk of each place.
        """
        n = len(points)
        bound, piece = np.ones(n + 1, bool), np.full(n, -1, np.int64)
        follow, before = np.arange(1, n + 2), np.arange(-1, n)  # of a symbol's start: the next and the last start
        start, end, rows = self.edges(points)
        size = np.bincount(chunk)
        long = size[chunk[start]] > LONG
        for c in np.unique(chunk[start[long]]):
            mine = long & (chunk[start] == c)
            self._by_heap(start[mine], end[mine], rows[mine], follow, before, bound, piece)
        start, end, rows = start[~long], end[~long], rows[~long]
        key = (self.piece_rank[rows] << 32) | start
        while len(start):
            # an edge is ready if its start and end are bounds with one bound between
            middle = follow[start]
            ready = np.flatnonzero(follow[np.minimum(middle, n - 1)] == end)
            if not len(ready):
                break
            of = chunk[start[ready]]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(key[ready], first)
            take = ready[key[ready] == np.repeat(best, np.diff(np.append(first, len(ready))))]
            s, e, m = start[take], end[take], middle[take]
            bound[m] = False
            piece[s] = rows[take]
            follow[s] = e
            before[e] = s
            active = np.zeros(len(size), bool)
            active[of] = True
            keep = active[chunk[start]] & bound[start] & bound[end]
            keep[take] = False
            start, end, rows, key = start[keep], end[keep], rows[keep], key[keep]
        return bound, piece

    def _by_heap(self, start, end, rows, follow, before, bound, piece) -> None:
        known = dict(zip(zip(start.tolist(), end.tolist()), rows.tolist()))
        rank = self.piece_rank
        heap: list[tuple[int, int, int]] = []

        def offer(s: int) -> None:
            e = int(follow[int(follow[s])])
            if (row := known.get((s, e))) is not None:
                heapq.heappush(heap, (int(rank[row]), s, e))

        for s in sorted(set(start.tolist())):
            offer(s)
        while heap:
            _, s, e = heapq.heappop(heap)
            m = int(follow[s])
            if not bound[s] or not bound[e] or m >= e or int(follow[m]) != e:
                continue
            bound[m] = False
            piece[s] = known[(s, e)]
            follow[s], before[e] = e, s
            if before[s] >= 0:
                offer(int(before[s]))
            if e < len(piece):
                offer(s)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has)."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        text = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        points = text + np.uint32(1)
        points[ends] = 0
        chunk = np.repeat(np.arange(len(chunks)), sizes + 1)
        bound, piece = self.symbols(points, chunk)
        starts = np.flatnonzero(bound[:-1])
        starts = starts[points[starts] > 0]
        ids = np.where(piece[starts] >= 0, self.piece_id[piece[starts]] if len(self.piece_id) else 0, -1)
        single = np.flatnonzero(ids < 0)
        letters, inverse = np.unique(text[starts[single]], return_inverse=True)
        table = np.array([self.id_of.get(chr(c), -1) for c in letters.tolist()], np.int64)
        ids[single] = table[inverse] if len(table) else ids[single]
        per = np.ones(len(starts), np.int64)
        if len(lost := np.flatnonzero(ids < 0)):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in text[starts[lost]].tolist()]
            per[lost] = [len(b) for b in spelled]
            out = np.repeat(ids, per)
            places = np.flatnonzero(np.repeat(ids < 0, per))
            out[places] = self.bytes_id[np.frombuffer(b"".join(spelled), np.uint8)]
        else:
            out = ids
        return out.astype(np.uint32), np.bincount(np.repeat(chunk[starts], per), minlength=len(chunks))


def _as_text(points: np.ndarray) -> np.ndarray:
    """Rows of code points as fixed-width strings, which numpy compares code point by code point."""
    rows = np.ascontiguousarray(points, np.uint32)
    return rows.view(f"U{rows.shape[1]}").ravel()


class Codec:
    """Encoding and decoding of whole texts with a memory of chunks."""

    def __init__(self, path: str) -> None:
        self.vocabulary, self.memo = Vocabulary(path), Memo()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.memo) > CACHE_CHUNKS:
            self.memo = Memo()
        split = [_CHUNK.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.memo.index))
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and (hi == lo or size + len(new[hi]) < INDEX_CHARS):
                size += len(new[hi])
                hi += 1
            self.memo.add(new[lo:hi], *self.vocabulary.encode_chunks(new[lo:hi]))
            lo = hi
        for chunks in split:
            yield self.memo.gather(chunks)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.vocabulary.raw
        text = b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in tb.blocks(batches):
        ids = [x.astype("<u4") for x in codec.encode(batch.column("text").to_pylist())]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(ids).view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ``ids`` of every text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _encode(it, model), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in batches:
        lists = batch.column("ids")
        texts = [codec.decode(np.array(lists[k].as_py() or [], np.int64)) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and ``text`` of every row of ids; null ids decode to an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, model), "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in tb.blocks(batches):
        texts, rows = batch.column("text").to_pylist(), []
        for doc_id, text, ids in zip(batch.column("doc_id").to_pylist(), texts, codec.encode(texts)):
            back = codec.decode(ids)
            rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
        )


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip: encoded and decoded again in one pass."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return texts.mapInArrow(lambda it: _digest(it, model), schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
