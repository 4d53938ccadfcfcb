"""Whole flows, from tables to delivered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaakya.functions import fixed
from vaakya.functions.text import fixed_point, percent
from vaakya.operators import disfluency, evaluate, lattice, segments, spelling
from vaakya.sources import io


def disfluency_flow(spark: SparkSession, manifest_path: str, output: str) -> DataFrame:
    """Manifest to detections, written as CSV."""
    found = disfluency.detect(io.read_manifest(spark, manifest_path))
    io.write_detections(found, output)
    return found


def spelling_flow(spark: SparkSession, words_path: str, output: str, lexicon_path: str | None = None) -> DataFrame:
    """Word list to verdicts, written as two CSV tables.  The list holds each word once, so no word is frequent."""
    verdicts = spelling.classify(io.read_words(spark, words_path), io.read_lexicon(spark, lexicon_path))
    io.write_spelling(verdicts, output)
    return verdicts


def lattice_flow(utterances: DataFrame, threshold: int = fixed.CONSENSUS) -> tuple[DataFrame, DataFrame]:
    """(scores of every system, corrections) of utterances with several systems' outputs."""
    lines = lattice.voted(lattice.aligned(utterances), threshold)
    return lattice.scores(lines), lattice.corrections(lines)


def manifest_flow(files: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, rejected, health) from transcript files and recordings' durations."""
    valid, rejected = segments.manifest(io.parse_transcripts(files), recordings)
    return valid, rejected, segments.health(valid, rejected)


def evaluation_flow(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, worst failures) of references and hypotheses."""
    lines = evaluate.prepared(samples)
    return evaluate.summary(lines), evaluate.top_failures(evaluate.failures(lines))


def _left(value, width: int) -> Column:
    """Padded on the right; longer values keep their length."""
    column = F.col(value) if isinstance(value, str) else value
    return F.rpad(column, F.greatest(F.lit(width), F.length(column)), F.lit(" "))


def _right(value, width: int) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.lpad(column, F.greatest(F.lit(width), F.length(column)), F.lit(" "))


# --- texts of reports: a few rows, so they are rows too -----------------------------------


def score_lines(scores: DataFrame) -> DataFrame:
    """``line``: a table row for each system, with the change and whether it improved."""
    change = F.col("delta") * 100
    sign = F.when(change > 0, F.lit("+")).otherwise(F.lit(""))
    mark = F.when(change < 0, F.lit(" ✅")).when(change == 0, F.lit(" ─")).otherwise(F.lit(""))
    delta = F.concat(F.when(change == 0, F.lit("+")).otherwise(sign), fixed_point(change, 2), F.lit("%"), mark)
    columns = (_left("name", 25), _left("standard_wer_pct", 15), _left("lattice_wer_pct", 15), _left(delta, 10))
    return scores.select("utt_id", "model_idx", F.concat_ws(" ", *columns).alias("line"))


def score_markdown(scores: DataFrame) -> DataFrame:
    change = F.col("delta") * 100
    sign = F.when(change >= 0, F.lit("+")).otherwise(F.lit(""))
    cells = ("name", "standard_wer_pct", "lattice_wer_pct", F.concat(sign, fixed_point(change, 2), F.lit("%")))
    return scores.select("utt_id", "model_idx", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def rate_lines(results: DataFrame) -> DataFrame:
    """``results(name, wer, cer, num_samples)`` as Markdown table rows."""
    cells = ("name", fixed_point(F.col("wer"), 2), fixed_point(F.col("cer"), 2), F.col("num_samples").cast("string"))
    return results.select("name", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def spelling_summary(verdicts: DataFrame) -> DataFrame:
    """One row: words, words of each label, and words of each layer as a map in the layers' order."""
    layers = spelling.by_layer(verdicts).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("by_layer"))  # six layers
    totals = verdicts.agg(
        F.count("*").alias("total_words"),
        F.count_if(F.col("classification") == "correct_spelling").alias("correct_spelling"),
        F.count_if(F.col("classification") == "incorrect_spelling").alias("incorrect_spelling"),
    )
    return totals.join(F.broadcast(layers), F.lit(True))


def bucket_lines(distribution: DataFrame) -> DataFrame:
    """Duration buckets by label, each with a bar of at most 50 blocks."""
    bar = F.repeat(F.lit("█"), F.least(F.col("n"), F.lit(50)).cast("int"))
    line = F.concat(_right("bucket", 8), F.lit(": "), _right(F.col("n").cast("string"), 5), F.lit("  "), bar)
    return distribution.select("bucket", line.alias("line")).orderBy("bucket")


def reason_lines(rejected: DataFrame) -> DataFrame:
    """Rejection reasons by falling count, of equal counts by name."""
    found = segments.rejection_reasons(rejected)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "reason_code"))  # as many rows as checks
    line = F.concat(_right(F.col("n").cast("string"), 5), F.lit("  "), F.col("reason_code"))
    return found.select(rank.alias("rank"), "reason_code", line.alias("line"))


def lattice_lines(positions: DataFrame) -> DataFrame:
    """A lattice's positions as lines, reference positions and the insertions before them."""
    words = F.concat_ws(" | ", "model_words")
    ops = F.concat_ws(" | ", F.transform("operations", lambda o: F.coalesce(F.left(o, F.lit(3)), F.lit("---"))))
    line = F.concat_ws(" | ", _right("key", 8), _left("ref_word", 12), words, ops)
    return positions.select("utt_id", "ref_pos", "is_insertion", "key", line.alias("line"))


def acceptance(health: DataFrame) -> DataFrame:
    """The report's formatted numbers; ``N/A`` where there was nothing to measure."""
    text = lambda c, digits: F.coalesce(fixed_point(F.col(c), digits), F.lit("N/A")).alias(c)
    return health.select(
        "total_segments_processed",
        "valid_segments",
        "rejected_segments",
        F.coalesce(percent(F.col("acceptance_percent") / 100, 1), F.lit("N/A")).alias("acceptance_rate"),
        *[text(c, 2) for c in ("total_audio_hours", "min_seconds", "max_seconds", "mean_seconds", "median_seconds")],
        "min_words",
        "max_words",
        text("mean_words", 1),
        "unique_recordings",
    )
