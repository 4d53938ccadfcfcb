"""Word alignment, word and character error rates.

The dynamic program is the one step without a native form that scales: an Arrow UDF returns
one letter an operation (C, S, D, I), and everything read off an alignment (pairs of words,
counts, rates) is a native expression over that string and the two word arrays.
"""

from __future__ import annotations

import sys
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaakya.functions.arrays import let, running

EPSILON = "<eps>"
NAMES = {"C": "correct", "S": "substitution", "D": "deletion", "I": "insertion"}


def operations(reference, hypothesis) -> str:
    """One letter an operation, from first to last.

    Of equally cheap alignments the one that, read from the end, takes a match before a
    substitution before a deletion before an insertion.
    """
    codes: dict[str, int] = {}
    ref = np.array([codes.setdefault(w, len(codes)) for w in reference], np.int64)
    hyp = np.array([codes.setdefault(w, len(codes)) for w in hypothesis], np.int64)
    n, m = len(ref), len(hyp)
    steps = np.arange(m + 1)

    def following(above: np.ndarray, i: int) -> np.ndarray:
        row = above + 1
        row[1:] = np.minimum(row[1:], above[:-1] + (hyp != ref[i - 1]))
        # an insertion costs one more than its left neighbour: a running minimum along the row
        return np.minimum.accumulate(row - steps) + steps

    # every k-th row of costs is kept, and the rows between two of them are made again on the way back
    every = max(1, isqrt(n))
    kept, row = [steps.copy()], steps
    for i in range(1, n + 1):
        row = following(row, i)
        if i % every == 0:
            kept.append(row)
    out, i, j = [], n, m
    while i:
        low = (i - 1) // every * every
        cost = [kept[low // every]]
        for k in range(low + 1, i + 1):
            cost.append(following(cost[-1], k))
        while i > low:
            here, above = cost[i - low], cost[i - 1 - low]
            if j and ref[i - 1] == hyp[j - 1]:
                out.append("C")
                i, j = i - 1, j - 1
            elif j and here[j] == above[j - 1] + 1:
                out.append("S")
                i, j = i - 1, j - 1
            elif here[j] == above[j] + 1:
                out.append("D")
                i -= 1
            else:
                out.append("I")
                j -= 1
    return "I" * j + "".join(reversed(out))


def _words(value) -> list:
    return [] if value is None else list(value)


@F.pandas_udf(T.StringType())
def align(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Operations of each pair of word arrays; a null array has no words."""
    return pd.Series([operations(_words(r), _words(h)) for r, h in zip(reference, hypothesis)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def align_each(reference: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """Operations of one word array against each of several."""
    return pd.Series([[operations(_words(r), _words(h)) for h in _words(hs)] for r, hs in zip(reference, hypotheses)])


def placed(ops: Column) -> Column:
    """array<struct<op, ref_at, hyp_at>>: each operation and how many words of either side it comes to."""

    def all_of(letters: Column) -> Column:
        without = lambda letter: running(F.transform(letters, lambda x: (x != letter).cast("int")))
        both = F.zip_with(without("I"), without("D"), lambda i, j: F.struct(i.alias("i"), j.alias("j")))
        return F.zip_with(letters, both, lambda x, at: F.struct(x.alias("op"), at["i"].alias("ref_at"), at["j"].alias("hyp_at")))

    return let(F.regexp_extract_all(ops, F.lit("."), F.lit(0)), all_of)


def pairs(reference: Column, hypothesis: Column, ops: Column) -> Column:
    """array<struct<ref, hyp, op, ref_at>> of an alignment; the side without a word has ``<eps>``."""
    names = F.create_map(*[F.lit(x) for p in NAMES.items() for x in p])
    return F.transform(
        placed(ops),
        lambda p: F.struct(
            F.when(p["op"] == "I", F.lit(EPSILON)).otherwise(F.get(reference, p["ref_at"] - 1)).alias("ref"),
            F.when(p["op"] == "D", F.lit(EPSILON)).otherwise(F.get(hypothesis, p["hyp_at"] - 1)).alias("hyp"),
            F.element_at(names, p["op"]).alias("op"),
            p["ref_at"].alias("ref_at"),
        ),
    )


def count_of(ops: Column, letter: str) -> Column:
    return F.length(ops) - F.length(F.replace(ops, F.lit(letter), F.lit("")))


def metrics(ops: Column) -> Column:
    """struct<wer, substitutions, deletions, insertions, correct, total_ref_words>."""
    s, d, i, c = (count_of(ops, x) for x in "SDIC")
    total = s + d + c
    return F.struct(
        ((s + d + i) / F.greatest(total, F.lit(1))).alias("wer"),
        s.alias("substitutions"),
        d.alias("deletions"),
        i.alias("insertions"),
        c.alias("correct"),
        total.alias("total_ref_words"),
    )


def corpus_rates(pairs_: DataFrame) -> DataFrame:
    """One row over ``ref_words, hyp_words, ops, reference, hypothesis``: wer and cer in percent.

    Errors of all pairs over reference units of all pairs; without any reference both are 100.
    """
    errors = F.length("ops") - count_of(F.col("ops"), "C")
    wer = F.sum(errors) / F.sum(F.size("ref_words")) * 100
    cer = F.sum(F.levenshtein("reference", "hypothesis")) / F.sum(F.length("reference")) * 100
    return pairs_.agg(
        F.coalesce(wer, F.lit(100.0)).alias("wer"), F.coalesce(cer, F.lit(100.0)).alias("cer"), F.count("*").alias("num_samples")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
