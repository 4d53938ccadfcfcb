"""Statistics of whole texts, from their bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from vaakya.llm import textbuf as tb

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "symbol_share",
    "stop_share", "bang_share", "pipe_share", "other_share", "high_share", "log_lines", "words_a_line",
    "repeated_lines", "distinct_words", "stutter", "most_common_word", "repeated_trigrams", "line_end_share",
)


def _members(*characters: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[[ord(c) for c in "".join(characters)]] = 1
    return out


_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _members("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _members("0123456789")
_SYMBOL = _members("#*$%&<>")
_STOP = _members(".,;:?")
_HIGH = np.arange(256) >= 0xC0  # first bytes of characters beyond ASCII
_CONTINUATION = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
CLASSES = np.stack(
    [_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _members("!"), _members("|"), _HIGH.astype(float), (~_CONTINUATION).astype(float)]
)


def _of(raw: np.ndarray, hashed: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> list[float]:
    upper, lower, digit, symbol, stop, bang, pipe, high, chars = CLASSES @ np.bincount(raw, minlength=256)
    n, size, letters = len(hashed), max(chars, 1.0), max(upper + lower + high, 1.0)
    lines = [x for x in raw.tobytes().split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    if n:
        counts = np.unique(hashed, return_counts=True)[1]
        distinct, most = len(counts) / n, counts.max() / n
        stutter = np.count_nonzero(hashed[1:] == hashed[:-1]) / n
        mean, spread = lengths.mean(), lengths.std()
    else:
        distinct = most = stutter = mean = spread = 0.0
    repeated = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines) / n_lines
    return [
        np.log1p(chars), np.log1p(n), mean, spread, upper / letters, digit / size, symbol / size, stop / size, bang / size,
        pipe / size, (size - letters - digit) / size, high / letters, np.log1p(len(lines)), n / n_lines,
        1 - len(set(lines)) / n_lines if lines else 0.0, distinct, stutter, most, repeated, ended,
    ]


def of_texts(column: pa.Array) -> np.ndarray:
    """One row a text; a null counts as empty, and empty texts have zeros where nothing can be measured."""
    raw, offs = tb.buffers(column)
    starts, ends, first = tb.words(raw, offs)
    hashed = tb.word_hashes(raw, starts, ends)
    grams = tb.chain(hashed, 3)
    out = np.zeros((len(offs) - 1, len(NAMES)), np.float64)
    for k in range(len(offs) - 1):
        lo, hi = first[k], first[k + 1]
        out[k] = _of(raw[offs[k] : offs[k + 1]], hashed[lo:hi], (ends - starts)[lo:hi], grams[lo : max(lo, hi - 2)])
    return out


def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and ``features``."""
    for batch in tb.blocks(batches):
        values = of_texts(batch.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["doc_id", "features"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
