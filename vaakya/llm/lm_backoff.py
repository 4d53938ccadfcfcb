"""Stupid-backoff language-model scores, relationally.

Relations: *grams(block, gram)*, the distinct n-grams of a block of documents; *counts(gram,
n)*, partitioned by ranges of the n-gram's hash; and the join of both, which brings each
block the counts of its own n-grams, from which documents are scored and summed.  A row of
such a relation holds a whole run of sorted 64-bit hashes in one binary value (differences,
by byte planes, compressed), so what is shuffled is some six bytes an n-gram and no hot
n-gram is sent more than once a block.

Score of a word after its context: count(context, word) / count(context) if the n-gram was
met MIN_COUNT times at least, else BACKOFF times the score with a shorter context; a single
word scores count / number of words.  A document's log score is the sum over its words.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand.  Null, empty and blank texts have no words, a
log score of 0 and a null mean.  Repeated rows count and are scored each.  Other columns are
ignored.
"""

from __future__ import annotations

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
from vaakya.llm.scratch import materialise, tidy

#: Longest n-gram. The exchange of count tables grows by about 1.3 x input with each order.
ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
#: Text of one block, and text whose n-grams one range of hashes holds, about.
BLOCK_TEXT = 8 << 20
RANGE_TEXT = 4 << 20

BLOCK_SCHEMA = "block long, words long, n_bytes long, docs binary"


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit values in about as many bytes as their differences need."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_TEXT of documents, as compressed Arrow streams."""
    part, made = TaskContext.get().partitionId(), 0

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink, words, size = pa.BufferOutputStream(), 0, 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
            for batch in held:
                raw, offs = tb.buffers(batch.column("text"))
                words += len(tb.words(raw, offs)[0])
                size += len(raw)
                out.write_batch(batch)
        values = [[(part << 32) | made], [words], [size], [sink.getvalue().to_pybytes()]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "words", "n_bytes", "docs"])

    held, size = [], 0
    for batch in tb.blocks(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_TEXT:
            yield row(held)
            held, size, made = [], 0, made + 1
            tb.trim()
    if held:
        yield row(held)


class Block:
    """Word hashes of a block's documents and their n-grams of each order."""

    def __init__(self, docs: bytes) -> None:
        self.ids: list[int | None] = []
        hashed, sizes = [], []
        for batch in pa.ipc.open_stream(docs):
            raw, offs = tb.buffers(batch.column("text"))
            starts, ends, first = tb.words(raw, offs)
            hashed.append(tb.word_hashes(raw, starts, ends))
            sizes.append(np.diff(first))
            self.ids += batch.column("doc_id").to_pylist()
        self.hashed, self.sizes = np.concatenate(hashed), np.concatenate(sizes)
        self.place = np.arange(len(self.hashed)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, n: int) -> np.ndarray:
        """The n-gram that ends at each word that has n - 1 words of its document before it."""
        keys = tb.chain(self.hashed, n)
        return tb.mix(keys[self.place[n - 1 :] >= n - 1] + np.uint64(n) * np.uint64(0x51_7C_C1_B7_27_22_0A_95))


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the key space begins in sorted ``keys``, and the end."""
    width = (1 << 64) // ranges + 1
    return np.searchsorted(keys, np.array([min(k * width, (1 << 64) - 1) for k in range(ranges)], np.uint64)).tolist() + [len(keys)]


def _ask(batches: Iterator[pa.RecordBatch], ranges: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs")):
            keys, counts = np.unique(Block(docs.as_py()).grams(n), return_counts=True)
            cuts = _ranges(keys, ranges)
            rows = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(rows), pa.int64()),
                    pa.array(rows, pa.int32()),
                    pa.array([pack_sorted(keys[cuts[k] : cuts[k + 1]]) for k in rows], pa.binary()),
                    pa.array([_small(counts[cuts[k] : cuts[k + 1]]) for k in rows], pa.binary()),
                ],
                ["block", "range", "keys", "own"],
            )
            del keys, counts
            tb.trim()


def _small(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _large(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def count_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one range of n-grams, for each block that asked."""
    asked = [unpack_sorted(x) for x in pdf["keys"]]
    own = np.concatenate([_large(x) for x in pdf["own"]])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, own)
    ends = np.cumsum([len(x) for x in asked])
    answers = [_small(counts[at[e - len(x) : e]]) for x, e in zip(asked, ends)]
    return pd.DataFrame({"block": pdf["block"], "range": pdf["range"], "counts": answers})


def score_block(block: Block, counts: dict[int, np.ndarray], words: int, order: int, least: int, backoff: float) -> np.ndarray:
    """Log score of each document of a block; counts[n] goes with the sorted distinct n-grams."""
    seen = []
    for n in range(1, order + 1):
        at = np.unique(block.grams(n), return_inverse=True)[1]
        full = np.zeros(len(block.hashed), np.int64)
        full[block.place >= n - 1] = counts[n][at] if len(at) else 0
        seen.append(full)
    score = seen[0] / max(words, 1)
    for n in range(2, order + 1):
        # the context is the (n - 1)-gram that ends one word before
        context = np.concatenate([[0], seen[n - 2][:-1]]) if len(score) else seen[n - 2]
        known = (seen[n - 1] >= least) & (block.place >= n - 1)
        score = np.where(known, seen[n - 1] / np.maximum(context, 1), np.where(block.place >= n - 1, backoff * score, score))
    logs, ends = np.log(score), np.cumsum(block.sizes)
    return np.array([logs[e - s : e].sum() for s, e in zip(block.sizes.tolist(), ends.tolist())], np.float64)


def backoff_scores(docs: DataFrame, order: int = ORDER, least: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialise(texts.mapInArrow(_to_blocks, BLOCK_SCHEMA), "blocks")
    size = blocks.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("words").alias("words")).first()
    words, ranges = size["words"] or 0, max(1, -(-(size["n_bytes"] or 0) // RANGE_TEXT))

    def counted(n: int) -> DataFrame:
        """Counts of the n-grams of order n for each block; the exchange is done with when it returns."""
        asked = blocks.select("block", "docs").mapInArrow(lambda it: _ask(it, ranges, n), "block long, range int, keys binary, own binary")
        counts = asked.groupBy("range").applyInPandas(count_range, "block long, range int, counts binary")
        return materialise(counts.withColumn("n", F.lit(n)), "counts")

    # one order after the other: the largest exchange is then that of one order
    answers = counted(1)
    for n in range(2, order + 1):
        tidy(docs.sparkSession)
        answers = answers.union(counted(n))
    tidy(docs.sparkSession)

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": [], "n_words": [], "log_score": []})
        block = Block(left["docs"].iloc[0])
        right = right.sort_values(["n", "range"], kind="stable")
        counts = {}
        for n in range(1, order + 1):
            parts = [_large(x) for x in right.loc[right["n"] == n, "counts"]]
            counts[n] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        scores = score_block(block, counts, words, order, least, backoff)
        found = pd.DataFrame(
            {"doc_id": pd.array(block.ids, "Int64"), "n_words": block.sizes.astype(np.int64), "log_score": scores}
        )
        del block, counts, left, right
        tb.trim()
        return found

    scored = (
        blocks.select("block", "docs")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(finish, "doc_id long, n_words long, log_score double")
    )
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
