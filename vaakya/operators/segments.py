"""Validation of timed segments, the manifest and the data-health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaakya.functions import fixed
from vaakya.functions.text import clean_text, count_words, fixed_point

#: reason code -> condition; the first that holds counts.
_CHECKS = (
    ("negative_start", lambda s, e, d, t: s < 0),
    ("end_le_start", lambda s, e, d, t: e <= s),
    ("end_gt_duration", lambda s, e, d, t: e > d + fixed.END_TOLERANCE),
    ("too_short", lambda s, e, d, t: e - s < fixed.MIN_SEGMENT),
    ("too_long", lambda s, e, d, t: e - s > fixed.MAX_SEGMENT),
    ("text_too_short", lambda s, e, d, t: F.length(t) < fixed.MIN_TEXT),
)
UNKNOWN_AUDIO = "unknown_audio_duration"


def _bounds() -> tuple[Column, Column, Column, Column]:
    missing = F.lit(-1.0)
    return (
        F.coalesce(F.col("start").cast("double"), missing),
        F.coalesce(F.col("end").cast("double"), missing),
        F.col("audio_duration").cast("double"),
        clean_text(F.col("text")),
    )


def reason_code() -> Column:
    """``OK`` or the code of the first check that fails, over start, end, audio_duration and text."""
    values = _bounds()
    out = F.when(F.coalesce(values[2] <= 0, F.lit(True)), F.lit(UNKNOWN_AUDIO))
    for code, fails in _CHECKS:
        out = out.when(fails(*values), F.lit(code))
    return out.otherwise(F.lit("OK"))


def reason_text() -> Column:
    """The reason in words, with the values that decided it."""
    s, e, d, t = _bounds()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = {
        UNKNOWN_AUDIO: F.lit("Cannot determine audio duration"),
        "negative_start": text("Negative start time: ", s),
        "end_le_start": text("end (", e, ") <= start (", s, ")"),
        "end_gt_duration": text("end (", e, ") > audio_duration (", d, ")"),
        "too_short": text("Too short: ", fixed_point(e - s, 2), f"s < {fixed.MIN_SEGMENT}s"),
        "too_long": text("Too long: ", fixed_point(e - s, 2), f"s > {fixed.MAX_SEGMENT}s"),
        "text_too_short": text("Text too short after cleaning: '", t, "'"),
    }
    out = F.when(F.col("reason_code") == "OK", F.lit("OK"))
    for code, words in said.items():
        out = out.when(F.col("reason_code") == code, words)
    return out


def validate(segments: DataFrame) -> DataFrame:
    """``segments`` with ``reason_code`` and ``reason``."""
    return segments.withColumn("reason_code", reason_code()).withColumn("reason", reason_text())


def manifest(segments: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) segments of ``segments`` joined to ``recordings(recording_id, audio_path, audio_duration)``.

    A segment of a recording that ``recordings`` lacks is rejected for its unknown duration.
    """
    judged = validate(segments.join(recordings, "recording_id", "left"))
    valid = judged.where("reason_code = 'OK'").select(
        "audio_path",
        clean_text(F.col("text")).alias("text"),
        (F.col("end") - F.col("start")).alias("duration"),
        "start",
        "end",
        "recording_id",
        "segment_index",
    )
    text = F.when(F.col("reason_code") != UNKNOWN_AUDIO, F.coalesce(F.col("text"), F.lit("")))
    rejected = judged.where("reason_code != 'OK'").select(
        "recording_id", "segment_index", "reason_code", "reason", text.alias("original_text")
    )
    return valid, rejected


def duration_bucket(duration: Column) -> Column:
    out = F.when(duration < 1, F.lit("<1s"))
    for low, high in ((1, 5), (5, 10), (10, 20), (20, 30)):
        out = out.when(duration < high, F.lit(f"{low}-{high}s"))
    return out.otherwise(F.lit(">30s"))


def duration_distribution(valid: DataFrame) -> DataFrame:
    return valid.groupBy(duration_bucket(F.col("duration")).alias("bucket")).agg(F.count("*").alias("n"))


def rejection_reasons(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason_code").agg(F.count("*").alias("n"))


def upper_median(frame: DataFrame, column: str) -> DataFrame:
    """One row ``median``: the value at half of the count in ascending order, the upper one of two.

    Values are counted first; running counts are taken within ranges of values and joined to
    the ranges' own running counts, so no task sorts the whole column.
    """
    counts = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    size = counts.agg(F.sum("n").alias("size"))  # one row
    running = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    parts = counts.withColumn("part", F.floor(F.col("value"))).join(F.broadcast(size), F.lit(True))
    whole = parts.groupBy("part").agg(F.sum("n").alias("m"))
    before = whole.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (
        parts.withColumn("upto", running)
        .join(before, "part")
        .where(F.col("before") + F.col("upto") > F.floor(F.col("size") / 2))
        .agg(F.min("value").alias("median"))
    )


def health(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of the report's numbers; nulls where there is nothing to measure."""
    words = count_words(F.col("text"))
    v = valid.select("duration", "recording_id", words.alias("words")).agg(
        F.count("*").alias("valid_segments"),
        (F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600).alias("total_audio_hours"),
        F.min("duration").alias("min_seconds"),
        F.max("duration").alias("max_seconds"),
        F.avg("duration").alias("mean_seconds"),
        F.coalesce(F.min("words"), F.lit(0)).alias("min_words"),
        F.coalesce(F.max("words"), F.lit(0)).alias("max_words"),
        F.avg("words").alias("mean_words"),
        F.count_distinct("recording_id").alias("unique_recordings"),
    )
    r = rejected.agg(F.count("*").alias("rejected_segments"))
    m = upper_median(valid, "duration").withColumnRenamed("median", "median_seconds")
    total = F.col("valid_segments") + F.col("rejected_segments")
    # each side is one row of aggregates
    return (
        v.join(F.broadcast(r), F.lit(True))
        .join(F.broadcast(m), F.lit(True))
        .select(
            total.alias("total_segments_processed"),
            "*",
            F.when(total > 0, F.col("valid_segments") / total * 100).alias("acceptance_percent"),
        )
    )


def split(frame: DataFrame, keys: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """``frame`` with ``fold``: ``train`` for int(n * (1 - share)) rows, else ``validation``.

    Membership follows a hash of the keys: the row of rank k in hash order trains if k is
    small enough.  Ranks come from counts of hash ranges and ranks within them, so no task
    orders all rows.  Sizes are exact; members are stable for the same keys and seed.
    """
    hashed = frame.withColumn("_hash", F.xxhash64(F.lit(seed), *keys))
    hashed = hashed.withColumn("_range", F.shiftright(F.col("_hash"), 52))
    sizes = hashed.groupBy("_range").agg(F.count("*").alias("_n"))  # at most 4096 ranges
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    sizes = sizes.select("_range", before.alias("_before"), total.alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *keys))
    train = F.col("_before") + F.col("_rank") <= F.floor(F.col("_total") * (1 - share))
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(sizes), "_range")
        .withColumn("fold", F.when(train, F.lit("train")).otherwise(F.lit("validation")))
        .drop("_hash", "_range", "_rank", "_before", "_total")
    )
