"""Toxicity by compression distance between two trained zstandard dictionaries.

One dictionary is trained on ordinary text, the other on toxic text.  Windows of one word and of
several, slid over a whole text, are compressed under both, and a window's distance is by how
many bytes the toxic dictionary makes it shorter.  A document is described by how many of its
windows pass each step of a ladder of distances, and a logistic model, the calibrated threshold,
turns that into a score.

Most of a toxic text is ordinary, so what the toxic dictionary is trained on is found by
compression too.  Training texts are dealt to folds.  A dictionary trained on the toxic texts
of each fold alone measures the windows of the other folds' texts; windows of toxic texts that
several such dictionaries shorten by more than they shorten nearly all windows of ordinary
texts are toxic text, the windows of ordinary texts that they shorten as much are ordinary
text, and both dictionaries are trained again.  A fold's dictionaries are trained on
the other folds' texts and its own texts are measured by them; scores are calibrated on those
distances, and how many folds must agree and how often this is repeated is chosen by the loss.
A document's score is the mean of what the best folds' dictionaries find.

Null and empty texts and texts without a letter have no window and get the score of that
case.  Without training rows of both kinds every score is 0.  Repeated rows are scored alike.
A row without a doc_id is scored and has a null ``held_out``.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.llm import textbuf as tb
from vaakya.llm.quality_gbdt import fold, train_sample
from vaakya.llm.worker import once

#: Labelled texts a model is fitted on at most (those with the smallest hash of doc_id), and
#: bytes of all their texts at most.
TRAIN_ROWS, TRAIN_BYTES = 5_000, 32 << 20
#: Bytes of the dictionaries, and of the segments each is trained to hold.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SEGMENT, TOXIC_SEGMENT = 256 << 10, 32 << 10, 32, 24
#: Ordinary samples a dictionary is trained on at most, and words of a sample.
ORDINARY_SAMPLES, SAMPLE_WORDS = 60_000, 8
FOLDS, ROUNDS, AGREE = 4, 2, (1, 2)
#: Ordinary texts that are measured in training, for each toxic one; they count for all.
MINED = 3
#: Share of the ordinary windows that toxic ones must be shortened more than.
SHARE = 0.99
CUT = 0.5
#: Folds whose dictionaries measure a document, those with the least loss.
KEPT_PAIRS = 2
#: Share of ordinary training texts that may be called toxic, and the loss from which the second
#: sort of longer windows is tried.
FALSE, POOR = 0.01, 0.3
#: Words a worker remembers the distances of before it starts anew, and how many new ones are
#: held before they are sorted in.
KNOWN, FRESH = 2_000_000, 200_000

#: What stands before and after each window, and in both dictionaries: a frame without any match
#: is stored raw, and no match begins in the last eight bytes of a frame.  A byte that no window
#: has is before it in dictionaries, so that it costs the same under each, whatever they end with.
MARK = bytes(range(1, 9))
LADDER = np.arange(1, 25)
#: Searches (strategy, least match) whose frames' lengths are added: one parse finds what another
#: one leaves, and their sum is finer than whole bytes of one frame.
FINE = ((zstandard.STRATEGY_BTOPT, 3), (zstandard.STRATEGY_BTLAZY2, 4))
#: Sorts of longer windows: their words, of how many words one begins, and their searches.  The
#: second sort tells phrases of ordinary words, and is five times as dear.
SORTS = ((2, 2, ((zstandard.STRATEGY_DFAST, 4),)), (3, 1, ((zstandard.STRATEGY_BTLAZY2, 4),)))

# a word is a run of ASCII letters and of bytes of other characters
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_PLAIN = np.where(_SOLID, np.arange(256), 0x20).astype(np.uint8)


@dataclass
class Words:
    """Texts as one buffer of words with one space between any two, and where words and texts begin."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def upto(self, texts: int) -> Words:
        """The first so many texts."""
        words = int(self.first[min(texts, len(self.first) - 1)])
        return Words(self.buffer, self.starts[:words], self.ends[:words], self.first[: texts + 1])

    def windows(self, words: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, text): every ``step``-th word of a text and those after it, with the spaces around."""
        n = np.diff(self.first)
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of))
        keep = (at - self.first[of]) % step == 0
        at, of = at[keep], of[keep]
        last = np.minimum(at + words, self.first[of + 1]) - 1
        return self.starts[at] - 1, self.ends[last] + 1, of


def read_words(texts: list[str | None]) -> Words:
    # a byte that is no part of a word ends each text, and one stands before the first
    joined = b" " + b" ".join((t or "").lower().encode("utf-8", "replace").replace(b"\x00", b" ") + b" \x00" for t in texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    ends_text = raw == 0
    plain = _PLAIN[raw]
    blank = plain == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    keep[0] = True
    place = np.cumsum(keep)
    buffer = plain[keep]
    solid = buffer != 0x20
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = place[ends_text]
    return Words(buffer, starts, ends, np.concatenate([[0], np.searchsorted(starts, cuts)]).astype(np.int64))


def gathered(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of spans of the buffer, one after the other, each between two MARKs."""
    n, lengths = len(MARK), end - begin + 2 * len(MARK)
    stop = np.cumsum(lengths)
    place, mark = stop - lengths, np.frombuffer(MARK, np.uint8)
    out = buffer[np.clip(np.arange(int(lengths.sum())) + np.repeat(begin - n - place, lengths), 0, max(len(buffer) - 1, 0))]
    for k in range(n):
        out[place + k] = mark[k]
        out[stop - n + k] = mark[k]
    return out, lengths


def spans(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    whole = buffer.tobytes()
    return [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes; samples too few to train on serve as they are."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 2)), samples, k=segment, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressors(content: bytes, searches: tuple[tuple[int, int], ...]) -> list[zstandard.ZstdCompressor]:
    """One a search, with ``content`` before every frame."""
    out = []
    for strategy, least in searches:
        held = zstandard.ZstdCompressionDict(content + 2 * (b"\x00" + MARK), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            window_log=21,
            chain_log=20,
            hash_log=19,
            search_log=6,
            min_match=least,
            target_length=64,
            strategy=strategy,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        held.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
    return out


def measured(bys: list[list[zstandard.ZstdCompressor]], buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of each window's frames by each group of searches: a row a group."""
    out = [np.zeros((len(bys), 0), np.int64)]
    for lo in range(0, len(begin), 1 << 17):
        data, lengths = gathered(buffer, begin[lo : lo + (1 << 17)], end[lo : lo + (1 << 17)])
        where = np.stack([np.cumsum(lengths) - lengths, lengths], 1).astype(np.uint64)
        held = zstandard.BufferWithSegments(data.tobytes(), where.tobytes())
        total = np.zeros((len(bys), len(lengths)), np.int64)
        for row, by in zip(total, bys):
            for each in by:
                frames = each.multi_compress_to_buffer(held, threads=0)
                row += np.fromiter(map(len, frames), np.int64, len(frames))
        out.append(total)
    return np.concatenate(out, 1)


class Ruler:
    """Distances of windows under two dictionaries; those of single words are remembered."""

    def __init__(self, ordinary: bytes, toxic: bytes, sort: int = 0) -> None:
        # under the toxic dictionary the ordinary one is there too: lengths differ by what is toxic alone
        self.fine, self.quick = ((compressors(ordinary, x), compressors(ordinary + toxic, x)) for x in (FINE, SORTS[sort][2]))
        self.known: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int16)) for _ in range(2)]

    def distance(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, fine: bool = True) -> np.ndarray:
        ordinary, toxic = measured(list(self.fine if fine else self.quick), buffer, begin, end)
        return ordinary - toxic

    def of_words(self, text: Words) -> np.ndarray:
        """Distance of each single word with the spaces around it."""
        hashes = tb.word_hashes(text.buffer, text.starts, text.ends)
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        gains, new = np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        for keys, values in self.known:  # the many, and those met since they were sorted
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            here = (keys[at] == distinct) if len(keys) else np.zeros(len(distinct), bool)
            gains[here] = values[at[here]] if len(keys) else 0
            new &= ~here
        at = first[new]
        gains[new] = self.distance(text.buffer, text.starts[at] - 1, text.ends[at] + 1)
        self._remember(1, distinct[new], gains[new])
        if len(self.known[1][0]) > FRESH:
            if len(self.known[0][0]) > KNOWN:
                self.known[0] = self.known[0][0][:0], self.known[0][1][:0]
            self._remember(0, *self.known[1])
            self.known[1] = self.known[1][0][:0], self.known[1][1][:0]
        return gains[where]

    def _remember(self, k: int, keys: np.ndarray, gains: np.ndarray) -> None:
        keys, gains = np.concatenate([self.known[k][0], keys]), np.concatenate([self.known[k][1], gains.astype(np.int16)])
        order = np.argsort(keys)
        self.known[k] = keys[order], gains[order]


def passed(text: Words, gains: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A row a text: how many of its windows pass each step of the ladder, by count and share."""
    n = len(text.first) - 1
    # windows by how many steps they pass, then those that pass a step at least
    steps = np.clip(gains, 0, len(LADDER))
    count = np.bincount(of * (len(LADDER) + 1) + steps, minlength=n * (len(LADDER) + 1)).reshape(n, len(LADDER) + 1)
    count = count[:, ::-1].cumsum(1)[:, ::-1]
    size, count = np.maximum(count[:, :1], 1), count[:, 1:]
    return np.concatenate([np.log1p(count), 30 * count / size, np.sqrt(count / size)], 1)


def described(text: Words, rulers: list[Ruler], sort: int = 0) -> np.ndarray:
    """[ruler, text, feature]: words by each ruler, and windows of several words, dealt to the rulers in turn."""
    n = len(text.first) - 1
    begin, end, of = text.windows(*SORTS[sort][:2])
    gains = np.zeros(len(of), np.int64)
    for k, ruler in enumerate(rulers):
        part = slice(k, None, len(rulers))
        gains[part] = ruler.distance(text.buffer, begin[part], end[part], False)
    both = [passed(text, gains, of), np.log1p(np.diff(text.first))[:, None], np.ones((n, 1))]
    whose = np.repeat(np.arange(n), np.diff(text.first))
    return np.stack([np.concatenate([passed(text, ruler.of_words(text), whose), *both], 1) for ruler in rulers])


@dataclass
class Model:
    """Pairs of dictionaries, ordinary and toxic, and the calibration; plain data, so it travels with a task."""

    pairs: list[tuple[bytes, bytes]]
    sort: int
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    loss: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Of rows of :func:`described`: the mean over the rulers of what each finds, as a probability."""
        margin = ((rows - self.shift) / self.scale @ self.weights).mean(0) - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shift, scale = x.mean(0), x.std(0) + 1e-9
    shift[-1], scale[-1] = 0, 1
    z, w = (x - shift) / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, z.T @ (weight * (p - y)) + ridge * w)
    return shift, scale, w


def _samples(text: Words) -> list[bytes]:
    return spans(text.buffer, *text.windows(SAMPLE_WORDS, SAMPLE_WORDS)[:2])


def _telling(text: Words, ordinary: bytes, toxic: list[bytes], agree: int, sort: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, gain) of the windows of each sort, each once a text; the gain is by the ``agree``-th shortest frame."""
    parts = []
    for words, searches in ((1, FINE), (SORTS[sort][0], SORTS[sort][2])):
        begin, end, of = text.windows(words, 1)
        keys = tb.word_hashes(text.buffer, begin, end)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        by = [compressors(ordinary + x, searches) for x in (b"", *toxic)]
        frames = measured(by, text.buffer, begin[first], end[first])
        gains = frames[0] - np.sort(frames[1:], 0)[min(agree, len(toxic)) - 1]
        once = np.unique(which * np.int64(len(text.first)) + of, return_index=True)[1]
        parts.append((begin[once], end[once], gains[which[once]]))
    return parts


def _some(samples: list[bytes], most: int) -> list[bytes]:
    """At most so many, mixed; the same ones for the same samples."""
    return [samples[k] for k in np.random.default_rng(0).permutation(len(samples))[:most]]


def calibrated(pairs: list[tuple[bytes, bytes]], plain: list[Words], bad: list[Words], share: float, sort: int) -> Model:
    """The model of pairs of dictionaries, each measured on its fold's texts; an ordinary one counts for ``share``."""
    x, y = [], []
    for pair, *kinds in zip(pairs, plain, bad):
        rulers = [Ruler(*pair, sort)]
        for label, text in enumerate(kinds):
            x.append(described(text, rulers, sort)[0])
            y.append(np.full(len(x[-1]), float(label)))
    whose = np.repeat(np.arange(len(pairs)), [sum(map(len, x[2 * f : 2 * f + 2])) for f in range(len(pairs))])
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.where(y == 1, 1.0, share)
    model = Model(pairs, sort, *_logistic(x, y, weight), 0.0, 0.0)
    p = np.clip(model.score(x[None]), 1e-9, 1 - 1e-9)
    losses = -weight * np.log(np.where(y == 1, p, 1 - p))
    model.loss = float(losses.sum() / weight.sum())
    each = np.bincount(whose, losses, len(pairs)) / np.maximum(np.bincount(whose, weight, len(pairs)), 1e-9)
    model.pairs = [pairs[f] for f in np.argsort(each, kind="stable")[:KEPT_PAIRS]]
    if (y == 0).any():
        model.threshold = max(0.0, float(np.quantile(np.log(p / (1 - p))[y == 0], 1 - FALSE)))
    return model


def train(texts: list[str | None], labels: list[int]) -> Model | None:
    """A model, or none without texts of both kinds; with the dearer windows where the others tell too little."""
    if len(set(labels)) < 2:
        return None
    pairs = trained_on(texts, labels, 0)
    return pairs if pairs.loss < POOR else min(pairs, trained_on(texts, labels, 1), key=lambda m: m.loss)


def trained_on(texts: list[str | None], labels: list[int], sort: int) -> Model:
    """A model with one sort of longer windows."""
    kinds = [[t for t, y in zip(texts, labels) if y == k] for k in (0, 1)]
    folds = min(FOLDS, max(2, len(kinds[1])))
    dealt = [[read_words(kind[f::folds]) for f in range(folds)] for kind in kinds]
    few = [x.upto(MINED * max(1, len(kinds[1]) // folds)) for x in dealt[0]]
    lines = [[_samples(x) for x in kind] for kind in dealt]
    but = lambda parts, f: [x for h in range(folds) if h != f for x in parts[h]]
    plain = [_some(but(lines[0], f), ORDINARY_SAMPLES) for f in range(folds)]
    share = len(kinds[0]) / max(1, sum(len(x.first) - 1 for x in few))
    best: Model | None = None
    for agree in AGREE:
        toxic, hard = lines[1], [[] for _ in range(folds)]
        for k in range(ROUNDS + 1):
            ordinary = [trained(plain[f] + but(hard, f), ORDINARY_BYTES, ORDINARY_SEGMENT) for f in range(folds)]
            if k:  # without a round the toxic dictionary is of ordinary words above all
                # calibrated on texts that the dictionaries have not seen
                pairs = [(ordinary[f], trained(but(toxic, f), TOXIC_BYTES, TOXIC_SEGMENT)) for f in range(folds)]
                model = calibrated(pairs, few, dealt[1], share, sort)
                best = min(best, model, key=lambda m: m.loss) if best else model
            if k == ROUNDS:
                break
            alone = [trained(toxic[f], TOXIC_BYTES, TOXIC_SEGMENT) for f in range(folds)]
            toxic, hard = [], []
            for f in range(folds):
                others = [alone[h] for h in range(folds) if h != f]
                plain_windows, toxic_windows = (_telling(t, ordinary[f], others, agree, sort) for t in (few[f], dealt[1][f]))
                toxic.append([])
                hard.append([])
                for (a, b, g), (c, d, h) in zip(plain_windows, toxic_windows):
                    least = max(1.0, float(np.quantile(g, SHARE))) if len(g) else 1.0
                    hard[f] += spans(few[f].buffer, a[g >= least], b[g >= least])
                    toxic[f] += spans(dealt[1][f].buffer, c[h > least], d[h > least])
    return best


def _score(batches: Iterator[pa.RecordBatch], model: Model | None, cut: float) -> Iterator[pa.RecordBatch]:
    rulers = []
    if model:
        key = model.sort, hashlib.sha256(b"".join(x for pair in model.pairs for x in pair)).digest()
        rulers = once("rulers", key, lambda: [Ruler(*pair, model.sort) for pair in model.pairs])
    for batch in tb.blocks(batches):
        if model:
            scores = model.score(described(read_words(batch.column("text").to_pylist()), rulers, model.sort))
        else:
            scores = np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: toxicity of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = train_sample(labels, "toxic", fold(F.col("doc_id"), 5) != 0, limit)
    rows = texts.join(sample, "doc_id")
    # numbers of at most ``limit`` rows come to the driver first, and then texts of TRAIN_BYTES at most
    sizes = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).orderBy(F.xxhash64("doc_id"), "size").limit(limit).toPandas()
    chosen = sizes.loc[sizes["size"].cumsum() <= TRAIN_BYTES, "doc_id"].drop_duplicates()
    some = docs.sparkSession.createDataFrame([(int(i),) for i in chosen], "doc_id long")
    found = rows.join(F.broadcast(some), "doc_id", "left_semi").orderBy("doc_id", "label", "text").limit(limit).select("text", "label").toPandas()
    model = train(found["text"].tolist(), found["label"].tolist())
    scored = texts.mapInArrow(lambda it: _score(it, model, cut), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
