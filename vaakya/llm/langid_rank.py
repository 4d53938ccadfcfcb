"""Language by rank-order profiles: out-of-place distance of a text's most frequent n-grams.

Letters are lower-cased, everything else counts as a gap between words; n-grams of 1 to
ORDER characters are taken with one gap at each side of a word.  A language's profile is its
KEPT most frequent n-grams in order, from a bounded sample of labelled texts.  A document's
n-grams are ranked the same way over its whole text; each costs the difference of its ranks
in the two profiles, or KEPT if the language does not have it.  The least sum wins.

A letter is what Unicode calls one, in every plane.  A null text, an empty text and a text
without a letter are ``und`` with score 0; so is every text if no row with a language may be
learned from.  A row without a doc_id is predicted, is not learned from and has a null
``held_out``.  Equal distances go to the language that
sorts first, equal counts of n-grams to the smaller n-gram by code points.  Repeated rows
are predicted alike.  Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaakya.llm import textbuf as tb
from vaakya.llm.quality_gbdt import fold

ORDER = 3
KEPT = 400
#: Texts a language's profile is learned from, about; chosen by a hash of doc_id.
TRAIN_TEXTS = 4000
UNKNOWN = "und"
#: What stands for anything between words; no letter.
GAP = 1

_state: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point -> itself for a letter, GAP for anything else; up to U+1FFFF."""
    if "letters" not in _state:
        _state["letters"] = np.array([c if chr(c).isalpha() else GAP for c in range(0x20000)], np.uint64)
    return _state["letters"]


def _letters(points: np.ndarray) -> np.ndarray:
    table = _letter_table()
    out = table[np.minimum(points, len(table) - 1)]
    for c in np.unique(points[points >= len(table)]).tolist():  # planes above: few texts have any
        out[points == c] = c if chr(c).isalpha() else GAP
    return out


def n_grams(text: str | None, order: int = ORDER) -> np.ndarray:
    """Keys of all n-grams of a text, 21 bits a character; empty for a text without letters.

    A gap is GAP and no character is 0, so n-grams of different lengths have different keys.
    """
    letters = _letters(np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    if not (letters > GAP).any():
        return np.zeros(0, np.uint64)
    padded = np.concatenate([[GAP], letters, [GAP]]).astype(np.uint64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > GAP) | (padded[:-1] > GAP)  # one gap stands for any run
    line = padded[keep]
    parts = [line[line > GAP]]
    grams = line
    for n in range(2, order + 1):
        grams = (grams[:-1] << np.uint64(21)) | line[n - 1 :]
        inner = np.ones(len(grams), bool)
        for k in range(1, n - 1):  # a gap inside would join two words
            inner &= line[k : k + len(grams)] > GAP
        parts.append(grams[inner])
    return np.concatenate(parts)


def ranked(keys: np.ndarray, counts: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The most frequent keys, in order."""
    if len(keys) > kept:
        least = np.partition(counts, len(counts) - kept)[len(counts) - kept]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:kept]


class Profiles:
    """Ranks of every language's n-grams, for lookups of whole profiles at once."""

    def __init__(self, languages: list[str], profiles: list[np.ndarray], kept: int = KEPT) -> None:
        self.languages, self.kept = languages, kept
        self.keys = np.unique(np.concatenate(profiles)) if profiles else np.zeros(0, np.uint64)
        self.ranks = np.full((len(languages), len(self.keys) + 1), -1, np.int64)
        for k, profile in enumerate(profiles):
            self.ranks[k, np.searchsorted(self.keys, profile)] = np.arange(len(profile))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = n_grams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(grams, return_counts=True), self.kept)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == own, at, len(self.keys)) if len(self.keys) else np.full(len(own), 0)
        there = self.ranks[:, at]
        cost = np.where(there >= 0, np.abs(there - np.arange(len(own))), self.kept).sum(1)
        near = 1 - cost / (self.kept * len(own))
        best = int(cost.argmin())
        # closeness of the winner, shared with the others as a softmax over closeness
        share = np.exp(20 * (near - near[best]))
        return self.languages[best], float(min(1.0, max(0.0, near[best])) ** 0.25 / share.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.blocks(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            grams = [n_grams(texts[k]) for k in np.flatnonzero(langs == lang)]
            keys, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())],
                ["lang", "gram", "n"],
            )


def learn(docs: DataFrame, train: Column, per_language: int = TRAIN_TEXTS, kept: int = KEPT) -> Profiles:
    """Profiles of every language among the rows ``train`` admits."""
    known = docs.where(train & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Profiles([], [], kept)
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)
    counts = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    rows = top.orderBy("lang", "rank").collect()  # ``kept`` rows a language
    found: dict[str, list[int]] = {lang: [] for lang in sorted(sizes)}
    for r in rows:
        found[r["lang"]].append(r["gram"])
    return Profiles(list(found), [np.array(g, np.int64).view(np.uint64) for g in found.values()], kept)


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in tb.blocks(batches):
        found = [profiles.predict(x) for x in batch.column("text").to_pylist()]
        columns = {c: batch.column(c) for c in batch.schema.names}
        columns["lang_pred"] = pa.array([x[0] for x in found], pa.string())
        columns["score"] = pa.array([x[1] for x in found], pa.float64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def tagged(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` as it is, with lang_pred and score; columns that had these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _predict(it, profiles), schema)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tagged(texts, profiles).select("doc_id", "lang_pred", "score")


def learn_folds(docs: DataFrame) -> Profiles:
    """Profiles of the rows outside the held-out fold."""
    return learn(docs, fold(F.col("doc_id"), 4) != 2)


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows outside the held-out fold."""
    return identify(docs, learn_folds(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
