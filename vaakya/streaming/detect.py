"""Disfluency detection over streams of segments: the batch projection, unchanged, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.operators.disfluency import detections


def counts(segments: DataFrame, time: str = "event_time", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Detections by window, type and category; rows later than ``late`` are left out."""
    timed = segments.withWatermark(time, late)
    found = timed.select(time, F.explode(detections(F.col("text"))).alias("d"))
    kinds = (F.col("d.type").alias("disfluency_type"), F.col("d.category").alias("disfluency_category"))
    return found.groupBy(F.window(time, width), *kinds).count()
