"""Disfluencies of text segments: fillers, repetitions, prolongations and false starts.

Detection is one projection: every detector is an array expression over a segment's tokens,
so a segment is read once, nothing is shuffled, and the same code runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaakya.functions import fixed
from vaakya.functions.arrays import let
from vaakya.functions.text import clean_token, fixed_point, nfc, tokens

DETECTION = (
    "struct<type:string,category:string,detected_text:string,positions:array<int>,"
    "character:string,repeat_count:int,marker:string>"
)


def lexicon_rows() -> list[tuple[str, int, str]]:
    """(category, rank, marker) in order."""
    return [(category, rank, m) for rank, (category, markers) in enumerate(fixed.MARKERS.items()) for m in markers]


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), "category string, category_rank int, marker string")


def all_markers(book: DataFrame) -> DataFrame:
    return book.select("marker").distinct()


def categories(book: DataFrame) -> DataFrame:
    return book.select("category").distinct()


def _markers() -> Column:
    """marker -> the first category that has it; markers are at most a few dozen."""
    first: dict[str, str] = {}
    for category, _, marker in lexicon_rows():
        first.setdefault(marker, category)
    return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])


def _detection(type_: str | Column, category: str | Column, text: Column, **more: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    kinds = {"positions": "array<int>", "character": "string", "repeat_count": "int", "marker": "string"}
    rest = [more.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
    return F.struct(lit(type_).alias("type"), lit(category).alias("category"), text.alias("detected_text"), *rest)


def fillers(words: Column, cleaned: Column) -> Column:
    """Tokens that, as they stand in lower case or without marks, are markers."""
    book = _markers()
    names = list(dict.fromkeys(m for _, _, m in lexicon_rows()))
    ranks = F.create_map(*[F.lit(x) for k, c in enumerate(fixed.MARKERS) for x in (c, k)])

    def one(word: Column, at: Column) -> Column:
        plain, lower = F.get(cleaned, at), F.lower(word)
        found = F.transform(F.filter(F.array(plain, lower), lambda x: x.isin(names)), lambda x: F.element_at(book, x))
        # either form may be a marker: the earlier category counts
        best = F.array_min(F.transform(found, lambda c: F.struct(F.element_at(ranks, c).alias("r"), c.alias("c"))))
        # few tokens are markers: a set lookup tells, and only hits look further
        return F.when(plain.isin(names) | lower.isin(names), _detection("filler", best["c"], word, positions=F.array(at)))

    return F.array_compact(F.transform(words, one))


def word_repetitions(words: Column, cleaned: Column) -> Column:
    """Neighbours that are equal without marks and longer than one character."""

    def one(word: Column, at: Column) -> Column:
        same = (F.get(cleaned, at) == F.get(cleaned, at + 1)) & (F.length(F.get(cleaned, at)) > 1)
        return F.when(same, _detection("word_repetition", "repetition", word, positions=F.array(at, at + 1)))

    return F.array_compact(F.transform(words, one))


def phrase_repetitions(words: Column, cleaned: Column) -> Column:
    """Two words that the next two repeat."""

    def one(word: Column, at: Column) -> Column:
        pair = lambda k: F.concat(F.get(cleaned, at + k), F.lit(" "), F.get(cleaned, at + k + 1))
        phrase = F.concat(word, F.lit(" "), F.get(words, at + 1))
        found = _detection("phrase_repetition", "repetition", phrase, positions=F.array(at, at + 1, at + 2, at + 3))
        return F.when(pair(0) == pair(2), found)

    return F.array_compact(F.transform(words, one))


def prolongations(words: Column) -> Column:
    """Every run of three or more of one character within a token."""

    def one(word: Column, at: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit(r"(.)\1{2,}"), F.lit(0))
        return F.transform(
            runs,
            lambda run: _detection(
                "prolongation", "prolongation", word, positions=F.array(at), character=F.left(run, F.lit(1)), repeat_count=F.length(run)
            ),
        )

    return F.flatten(F.transform(words, one))


def false_starts(text: Column) -> Column:
    """Interruption marks in the text as it stands, and texts of one or two words."""
    found = lambda when, marker: F.when(when, _detection("false_start", "false_start", text, marker=F.lit(marker)))
    return F.array_compact(
        F.array(
            found(text.rlike(r"\.\.|—|–"), "interruption_punctuation"),
            found(F.size(tokens(text)).between(1, 2), "very_short_utterance"),
        )
    )


def detections(text: Column) -> Column:
    """All detections of a segment's text in order; null and blank texts have none."""

    def all_of(words: Column) -> Column:
        cleaned = F.transform(words, clean_token)
        return let(
            cleaned,
            lambda c: F.concat(fillers(words, c), word_repetitions(words, c), phrase_repetitions(words, c), prolongations(words), false_starts(text)),
        )

    found = let(tokens(nfc(text)), all_of)
    return F.coalesce(found, F.array().cast(f"array<{DETECTION}>"))


def detect(segments: DataFrame) -> DataFrame:
    """One row a detection of ``segments(recording_id, segment_index, start, end, text, ...)``.

    Missing ids take the segment's own ``row`` number where there is one, ``unknown_{row}``, and
    else a number of its place: those of one partition follow each other, and none repeats.  On a
    stream, which has no places, it is 0.
    """
    have = segments.columns
    if "row" not in have:
        segments = segments.withColumn("row", F.lit(0) if segments.isStreaming else F.monotonically_increasing_id())
    row = F.col("row")
    recording = F.coalesce(F.col("recording_id").cast("string"), F.concat(F.lit("unknown_"), row.cast("string")))
    index = F.coalesce(F.col("segment_index"), row).cast("string")
    audio = F.col("audio_clip_path") if "audio_clip_path" in have else F.lit("")
    base = segments.select(
        recording.alias("recording_id"),
        F.concat(recording, F.lit("_seg"), index).alias("segment_id"),
        F.col("start").alias("start_time"),
        F.col("end").alias("end_time"),
        F.col("text").alias("transcript_text"),
        audio.alias("audio_clip_path"),
        F.posexplode(detections(F.col("text"))).alias("detection_index", "d"),
    )
    return base.select(
        "recording_id",
        "segment_id",
        "start_time",
        "end_time",
        F.col("d.type").alias("disfluency_type"),
        F.col("d.category").alias("disfluency_category"),
        F.coalesce("d.detected_text", F.lit("")).alias("detected_text"),
        "transcript_text",
        "audio_clip_path",
        "detection_index",
        *[F.col(f"d.{c}").alias(c) for c in ("positions", "character", "repeat_count", "marker")],
    )


#: Columns of the delivered table, in order.
OUTPUT = (
    "recording_id", "segment_id", "start_time", "end_time", "disfluency_type", "disfluency_category",
    "detected_text", "transcript_text", "audio_clip_path",
)


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("disfluency_type").count().withColumnRenamed("count", "n")


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("disfluency_category").count().withColumnRenamed("count", "n")


def rates(segments: DataFrame) -> DataFrame:
    """One row: segments, detections, segments with any, and both rates, in one pass over texts."""
    n = F.size(detections(F.col("text")))
    total = F.greatest(F.col("total_segments"), F.lit(1))
    return (
        segments.select(n.alias("n"))
        .agg(
            F.count("*").alias("total_segments"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_detections"),
            F.count_if(F.col("n") > 0).alias("segments_with_disfluency"),
        )
        .select(
            "*",
            (F.col("total_detections") / total * 100).alias("detections_per_100_segments"),
            (F.col("segments_with_disfluency") / total * 100).alias("segment_rate_percent"),
        )
    )


def clip_names(segments: DataFrame) -> DataFrame:
    """``clip_name`` of each segment whose times allow a clip, else null."""
    both = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))
    name = F.concat(
        F.col("recording_id").cast("string"), F.lit("_seg_"), fixed_point(F.col("start"), 2), F.lit("_"), fixed_point(F.col("end"), 2), F.lit(".wav")
    )
    return segments.withColumn("clip_name", F.when(both, name))


def clips(found: DataFrame) -> DataFrame:
    """Each clip once: ``recording_id, start, end, clip_name`` of segments with a detection whose times allow one."""
    times = found.select("recording_id", F.col("start_time").alias("start"), F.col("end_time").alias("end")).distinct()
    return clip_names(times).where("clip_name is not null")
