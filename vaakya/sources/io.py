"""Sources and sinks.  Paths are whatever Spark's readers open; nothing is read on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaakya.functions.text import nfc, strip
from vaakya.operators.disfluency import OUTPUT
from vaakya.operators.spelling import core_lexicon, ordered_distinct

MANIFEST = "audio_path string, text string, duration double, start double, end double, recording_id string, segment_index int"
DEFAULT_BASE = "https://storage.example.com/recordings"
KINDS = ("recording", "transcription", "metadata")


def url(user_id: Column, recording_id: Column, kind: str, base: str = DEFAULT_BASE) -> Column:
    """``{base}/{user}/{recording}_{kind}``, ``.wav`` for the recording and ``.json`` for the others."""
    end = ".wav" if kind == "recording" else ".json"
    return F.concat(F.lit(f"{base}/"), user_id.cast("string"), F.lit("/"), recording_id.cast("string"), F.lit(f"_{kind}{end}"))


def urls(recordings: DataFrame, base: str = DEFAULT_BASE) -> DataFrame:
    """``recordings(user_id, recording_id, ...)`` with audio_url, transcription_url and metadata_url.

    Rows without ids (null, 0 or empty) are left out.  A URL column that is there counts as it
    is, null included.
    """
    blank = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("", "0")
    made = {
        name: url(F.col("user_id"), F.col("recording_id"), kind, base)
        for name, kind in zip(("audio_url", "transcription_url", "metadata_url"), KINDS)
    }
    given = {"audio_url": "rec_url_gcp", "transcription_url": "transcription_url", "metadata_url": "metadata_url"}
    columns = {name: F.col(given[name]) if given[name] in recordings.columns else value for name, value in made.items()}
    return recordings.where(~blank("user_id") & ~blank("recording_id")).withColumns(columns)


def missing(recordings: DataFrame, listing: DataFrame) -> DataFrame:
    """Recordings whose file is not in ``listing(recording_id)`` yet."""
    return recordings.join(listing.select("recording_id"), "recording_id", "left_anti")


def fetch(recordings: DataFrame, get: Callable[[str], bytes | None], column: str = "audio_url") -> DataFrame:
    """``recordings`` with ``content``, by a function of the caller that opens a URL; null where it gives nothing.

    The engine itself opens no network connection.
    """
    schema = recordings.withColumn("content", F.lit(None).cast("binary")).schema

    def read(batches):
        for pdf in batches:
            pdf["content"] = [get(u) or None if u else None for u in pdf[column]]
            yield pdf

    return recordings.mapInPandas(read, schema)


def batch_report(fetched: DataFrame) -> DataFrame:
    """One row: success, failures, total."""
    ok = F.col("content").isNotNull()
    return fetched.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failures"), F.count("*").alias("total"))


def parse_transcripts(files: DataFrame) -> DataFrame:
    """Valid segments of ``files(recording_id, content)``, whose content is a JSON list of objects.

    A row needs start and end that read as numbers (texts of numbers and booleans do) and a
    text that is a string; others, and contents that are not lists, give no row.
    ``segment_index`` counts the valid rows of a file; other keys are kept in ``extra``.
    """
    items = F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$", "array<variant>")

    def number(v: Column, key: str) -> Column:
        text = F.try_variant_get(v, f"$.{key}", "string")
        return F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))

    def parsed(v: Column) -> Column:
        whole = F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING"
        return F.struct(
            number(v, "start").alias("start"),
            number(v, "end").alias("end"),
            F.try_variant_get(v, "$.speaker_id", "int").alias("speaker_id"),
            F.when(whole, F.try_variant_get(v, "$.text", "string")).alias("text"),
            F.to_json(v).alias("extra"),
        )

    good = lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull()
    rows = F.filter(F.transform(items, parsed), good)
    return files.select("recording_id", F.posexplode(rows).alias("segment_index", "s")).select("recording_id", "segment_index", "s.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of every JSON file under ``path``; the file's name is the recording."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(_transcription)?(\.[^./]*)?$", 1).alias("recording_id"), F.col("value").alias("content")
    )
    return parse_transcripts(files)


def write_manifest(valid: DataFrame, path: str) -> None:
    """JSON lines in UTF-8."""
    valid.write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from wherever the whole path says."""
    return spark.read.schema(MANIFEST).json(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, ord`` of a list in text, CSV or JSON: normal forms, each once at its first place.

    JSON is an array of strings or an object with ``words``; a CSV's words are its first column
    among word, Word, words, text and token, or its first column at all.
    """
    if path.endswith(".json"):
        value = F.try_parse_json("value")
        listed = F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.try_variant_get(value, "$.words", "array<string>"))
        raw = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("ord", "word"))
        raw = raw.where(strip(F.col("word")) != "")
    elif path.endswith(".csv"):
        frame = spark.read.csv(path, header=True, multiLine=True, escape='"')
        name = next((c for c in ("word", "Word", "words", "text", "token") if c in frame.columns), frame.columns[0])
        raw = frame.select(F.col(f"`{name}`").alias("word")).where("word is not null").withColumn("ord", F.monotonically_increasing_id())
    else:
        raw = spark.read.text(path).select(F.col("value").alias("word"), F.monotonically_increasing_id().alias("ord"))
        raw = raw.where(strip(F.col("word")) != "")
    return ordered_distinct(raw.select("word", F.col("ord").cast("long").alias("ord")))


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The core lexicon and the words of a file of one word a line."""
    words = core_lexicon(spark)
    if path:
        more = spark.read.text(path).select(nfc(strip(F.col("value"))).alias("word")).where("word != ''")
        words = words.union(more)
    return words.distinct()


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """``utt_id, reference, models`` of a JSON object or a list of objects {reference, models: {name: text}}.

    Systems stand in the order of the file, which decides between words with equal votes.
    """
    one = "struct<reference:string,models:map<string,string>>"
    text = F.ltrim("value")
    # a map keeps the order of its entries; an object is a list of one
    items = F.when(text.startswith("["), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(items).alias("utt_id", "v"))
    listed = F.transform(
        F.map_entries("v.models"), lambda m, i: F.struct(i.alias("model_idx"), m["key"].alias("name"), m["value"].alias("hyp"))
    )
    return rows.select("utt_id", "v.reference", listed.alias("models"))


def write_detections(found: DataFrame, path: str) -> bool:
    """The nine delivered columns as CSV; nothing is written for no detections."""
    if found.isEmpty():
        return False
    found.select(*OUTPUT).write.csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")
    return True


def write_spelling(verdicts: DataFrame, path: str) -> None:
    """Two CSV tables under ``path``: words with labels, and all six columns."""
    verdicts.select("word", "classification").write.csv(f"{path}/labels", header=True, escape='"', emptyValue="")
    columns = ("word", "classification", "detailed_classification", "reason", "layer", "suggestion")
    verdicts.select(*columns).write.csv(f"{path}/details", header=True, escape='"', emptyValue="")


def write_rows(frame: DataFrame, path: str) -> None:
    """Any result as JSON lines."""
    frame.write.json(path)
