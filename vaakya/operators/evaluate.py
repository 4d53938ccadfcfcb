"""Evaluation of transcripts against references: corpus rates and the worst cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.functions import fixed
from vaakya.functions.text import fixed_point, normalize_for_wer, strip, tokens
from vaakya.operators.align import align, corpus_rates, count_of


def prepared(samples: DataFrame, max_samples: int | None = None) -> DataFrame:
    """``samples(idx, reference, hypothesis)`` normalised and aligned; blank references are left out.

    ``max_samples`` takes the first by idx before anything is left out.
    """
    if max_samples:
        samples = samples.orderBy("idx").limit(max_samples)
    base = samples.select(
        "idx", normalize_for_wer(F.col("reference")).alias("reference"), normalize_for_wer(F.col("hypothesis")).alias("hypothesis")
    ).where("reference != ''")
    words = base.withColumns({"ref_words": tokens(F.col("reference")), "hyp_words": tokens(F.col("hypothesis"))})
    lines = words.withColumn("ops", align(F.col("ref_words"), F.col("hyp_words")))
    errors = F.length("ops") - count_of(F.col("ops"), "C")
    rate = F.when(F.col("hypothesis") == "", F.lit(1.0)).otherwise(errors / F.size("ref_words"))
    return lines.withColumn("sample_wer", rate)


def failures(lines: DataFrame, above: float = fixed.FAILURE) -> DataFrame:
    """Samples whose error rate is above the limit, with the rate as text."""
    wer = F.concat(fixed_point(F.col("sample_wer") * 100, 1), F.lit("%"))
    return lines.where(F.col("sample_wer") > above).select("idx", "reference", "hypothesis", "sample_wer", wer.alias("wer"))


def top_failures(found: DataFrame, most: int = fixed.TOP_FAILURES, numeric: bool = False) -> DataFrame:
    """The worst failures.  The delivered order compares the rates' texts; ``numeric`` their values.

    Equal rates stand in the order of idx.
    """
    return found.orderBy(F.desc("sample_wer" if numeric else "wer"), "idx").limit(most)


def summary(lines: DataFrame) -> DataFrame:
    """One row: wer and cer in percent, samples and failures."""
    return corpus_rates(lines).join(
        F.broadcast(lines.agg(F.count_if(F.col("sample_wer") > fixed.FAILURE).alias("num_failures"))), F.lit(True)
    )


def training_metrics(samples: DataFrame) -> DataFrame:
    """One row ``wer`` in percent over samples whose reference is not blank; 1.0 without any."""
    words = samples.where(strip(F.col("reference")) != "").select(
        tokens(F.col("reference")).alias("ref_words"), tokens(F.col("hypothesis")).alias("hyp_words")
    )
    lines = words.withColumn("ops", align(F.col("ref_words"), F.col("hyp_words")))
    errors = F.length("ops") - count_of(F.col("ops"), "C")
    return lines.agg(F.coalesce(F.sum(errors) / F.sum(F.size("ref_words")) * 100, F.lit(1.0)).alias("wer"))
