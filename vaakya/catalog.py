"""Registered queries of the engine's own operators and the SQL that states the same results.

Queries read whole tables.  Behaviour that the tables cannot show (Devanagari, marks, limits)
is queried over small fixtures, which the SQL states as VALUES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaakya.functions import devanagari, fixed, text
from vaakya.operators import align, audio, disfluency, evaluate, lattice, segments, spelling
from vaakya.plans import transcripts
from vaakya.sources import io

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL of the same result."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def array_sql(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


# --- SQL of the text functions ------------------------------------------------------------

_PUNCT = r"""[।॥,.?!;:''"\-–—()\[\]{}<>«»…/\\@#$%\^&*+=|~`]"""
_DEVA = r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}\x{1CD0}-\x{1CFF}"
_WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _tokens_sql(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^{_WS}]+')"


def _collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _clean_sql(x: str) -> str:
    return _collapse_sql(f"regexp_replace(nfc_normalize(coalesce({x}, '')), '{_PUNCT}', ' ', 'g')")


def _wer_text_sql(x: str) -> str:
    return _collapse_sql(rf"regexp_replace(lower({_clean_sql(x)}), '[^\p{{L}}\p{{N}}{_DEVA} ]', '', 'g')")


def _token_clean_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[।,.?!]', '', 'g')"


def _share_sql(x: str, threshold: float) -> str:
    solid = f"regexp_replace(coalesce({x}, ''), '[{_WS}]', '', 'g')"
    return f"(CASE WHEN length({solid}) > 0 THEN length(regexp_replace({solid}, '[^{_DEVA}]', '', 'g')) / length({solid}) >= {threshold} ELSE false END)"


# --- text functions over whole tables -------------------------------------------------------


@query(f"SELECT conv_id, turn, {_clean_sql('text')} AS cleaned FROM conversations")
def t2_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {_wer_text_sql('text')} AS normalised FROM documents")
def t3_normalize_for_wer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_for_wer(F.col("text")).alias("normalised"))


@query(f"SELECT doc_id, len({_tokens_sql('text')})::INTEGER AS n_words, {_share_sql('text', 0.5)} AS devanagari FROM documents")
def t7_count_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.count_words(F.col("text")).alias("n_words"), text.is_devanagari(F.col("text")).alias("devanagari")
    )


@query(
    f"""SELECT token, count(*) AS n FROM (SELECT unnest(list_transform({_tokens_sql("text")}, lambda w: {_token_clean_sql("w")})) AS token FROM conversations)
    GROUP BY token"""
)
def t9_clean_tokens(spark, sf_dir):
    words = F.transform(text.tokens(F.col("text")), text.clean_token)
    return table(spark, sf_dir, "conversations").select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_PHRASES = [
    (1, "मैं, school  जा रहा हूं।"),
    (2, "Hello world"),
    (3, "  "),
    (4, None),
    (5, "क़लम और ऩयी — «किताब» … १२३ ½ ² é"),
    (6, "a_b 'quote' x²"),
    (7, "हां ok now"),
    (8, "abक"),
]
_PHRASES_SQL = f"{values(_PHRASES)} AS t(id, text)"


def _phrases(spark):
    return spark.createDataFrame(_PHRASES, "id int, text string")


@query(
    rf"""SELECT id, {_clean_sql("text")} AS cleaned, {_wer_text_sql("text")} AS normalised, {_share_sql("text", 0.5)} AS devanagari,
    array_to_string(list_filter({_tokens_sql("text")}, lambda w: {_share_sql("w", 0.3)}), ' ') AS kept, len({_tokens_sql("text")})::INTEGER AS n_words,
    nfc_normalize(text) AS nfc FROM {_PHRASES_SQL}"""
)
def t_devanagari_text(spark, sf_dir):
    t = F.col("text")
    return _phrases(spark).select(
        "id",
        text.clean_text(t).alias("cleaned"),
        text.normalize_for_wer(t).alias("normalised"),
        text.is_devanagari(t).alias("devanagari"),
        text.remove_english_words(t).alias("kept"),
        text.count_words(t).alias("n_words"),
        text.nfc(t).alias("nfc"),
    )


_ENGLISH = [(" मोबाइल ",), ("बस",), ("गूगल",), ("कुत्ता",)]


@query(
    f"SELECT w.word, m.english FROM {values(_ENGLISH)} AS w(word) LEFT JOIN {values(list(fixed.COMMON_TRANSLITERATIONS.items()))} AS m(word, english) "
    "ON trim(w.word) = m.word"
)
def t6_transliterate_check(spark, sf_dir):
    return spark.createDataFrame(_ENGLISH, "word string").select("word", text.transliterate_check(F.col("word")).alias("english"))


_MARKED = [
    (w,)
    for w in ("मैं", "ामैं", "क््षत्रिय", "खानाा", "क़लम", "़क", "्क", "अ्क", "अ़", "abc", "क१", "ॐ", "", "क ख", "कंः", "हैंं", "काीख्")
]


@query(
    r"""SELECT word, regexp_matches(nfc_normalize(word), '^[\x{0901}-\x{0903}\x{0904}-\x{0939}\x{093C}\x{093E}-\x{094D}\x{0958}-\x{095F}\x{0966}-\x{096F}\s]*$') AS pure,
    length(regexp_replace(nfc_normalize(word), '[^\x{0915}-\x{0939}\x{0958}-\x{095F}]', '', 'g'))::INTEGER AS consonants,
    length(regexp_replace(nfc_normalize(word), '[^\x{0904}-\x{0914}]', '', 'g'))::INTEGER AS vowels,
    length(regexp_replace(nfc_normalize(word), '[^\x{093E}-\x{094C}]', '', 'g'))::INTEGER AS matras,
    (length(nfc_normalize(word)) - length(replace(nfc_normalize(word), chr(2381), '')))::INTEGER AS virama,
    (length(nfc_normalize(word)) - length(replace(nfc_normalize(word), chr(2364), '')))::INTEGER AS nukta FROM """
    + f"{values(_MARKED)} AS t(word)"
)
def t12_character_breakdown(spark, sf_dir):
    parts = devanagari.character_breakdown(F.col("word"))
    return spark.createDataFrame(_MARKED, "word string").select(
        "word", devanagari.is_pure(F.col("word")).alias("pure"), *[parts[c].alias(c) for c in ("consonants", "vowels", "matras", "virama", "nukta")]
    )


_FAULTS_SQL = f"""
WITH w AS (SELECT word, nfc_normalize(word) AS t FROM {values(_MARKED)} AS v(word)),
c AS (SELECT word, i - 1 AS position, ord(substr(t, i, 1)) AS c, CASE WHEN i > 1 THEN ord(substr(t, i - 1, 1)) END AS p,
        CASE WHEN i < length(t) THEN ord(substr(t, i + 1, 1)) END AS n
      FROM (SELECT word, t, unnest(range(1, length(t) + 1)) AS i FROM w)),
f AS (SELECT word, position, CASE
        WHEN c BETWEEN 2366 AND 2380 AND n BETWEEN 2366 AND 2380 THEN 'consecutive_matras'
        WHEN c BETWEEN 2366 AND 2380 AND p IS NULL THEN 'initial_matra'
        WHEN c = 2381 AND p IS NULL THEN 'initial_virama'
        WHEN c = 2381 AND NOT (p BETWEEN 2325 AND 2361 OR p BETWEEN 2392 AND 2399 OR p = 2364) THEN 'virama_without_consonant'
        WHEN c = 2364 AND p IS NULL THEN 'initial_nukta'
        WHEN c = 2364 AND NOT (p BETWEEN 2325 AND 2361 OR p BETWEEN 2392 AND 2399) THEN 'nukta_without_consonant' END AS rule FROM c)
SELECT w.word, CASE WHEN w.t = '' THEN 0 ELSE x.position END::INTEGER AS position, CASE WHEN w.t = '' THEN 'empty' ELSE x.rule END AS rule
FROM w LEFT JOIN (SELECT word, min(position) AS position, arg_min(rule, position) AS rule FROM f WHERE rule IS NOT NULL GROUP BY word) x USING (word)
"""


@query(_FAULTS_SQL)
def t11_unicode_validity(spark, sf_dir):
    fault = devanagari.first_fault(F.col("word"))
    return spark.createDataFrame(_MARKED, "word string").select("word", fault["position"].alias("position"), fault["rule"].alias("rule"))


# --- segments from conversations --------------------------------------------------------------


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as timed segments: 0.4 s a word, one after the other in a conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", text.count_words(F.col("text")).cast("long"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("upto", upto).select(
        F.col("conv_id").cast("string").alias("recording_id"),
        F.col("turn").cast("int").alias("segment_index"),
        ((F.col("upto") - F.col("n")) * F.lit(0.4)).alias("start"),
        (F.col("upto") * F.lit(0.4)).alias("end"),
        "text",
    )


def conversation_recordings(parts: DataFrame) -> DataFrame:
    """Durations up to 3 s short of the last segment's end; every 17th recording has none."""
    number = F.col("recording_id").cast("long")
    length = F.when(number % 17 == 0, F.lit(-1.0)).otherwise(F.col("last") - number % 4)
    return parts.groupBy("recording_id").agg(F.max("end").alias("last")).select(
        "recording_id", F.concat(F.lit("audio/"), "recording_id", F.lit(".wav")).alias("audio_path"), length.alias("audio_duration")
    )


_SEGMENTS_SQL = f"""
turns AS (SELECT conv_id, turn, text, len({_tokens_sql("text")}) AS n FROM conversations),
upto AS (SELECT *, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS u FROM turns),
segments AS (SELECT conv_id::VARCHAR AS recording_id, turn::INTEGER AS segment_index, (u - n) * 0.4::DOUBLE AS "start", u * 0.4::DOUBLE AS "end", text FROM upto),
recordings AS (SELECT recording_id, CASE WHEN recording_id::BIGINT % 17 = 0 THEN -1.0::DOUBLE ELSE max("end") - recording_id::BIGINT % 4 END AS audio_duration
  FROM segments GROUP BY recording_id),
judged AS (SELECT s.*, {_clean_sql("text")} AS cleaned, CASE WHEN audio_duration <= 0 THEN 'unknown_audio_duration' WHEN "start" < 0 THEN 'negative_start'
  WHEN "end" <= "start" THEN 'end_le_start' WHEN "end" > audio_duration + 1.0 THEN 'end_gt_duration' WHEN "end" - "start" < 0.5 THEN 'too_short'
  WHEN "end" - "start" > 30.0 THEN 'too_long' WHEN length({_clean_sql("text")}) < 1 THEN 'text_too_short' ELSE 'OK' END AS reason_code
  FROM segments s JOIN recordings r USING (recording_id))
"""


def _judged(spark, sf_dir):
    parts = conversation_segments(spark, sf_dir)
    return segments.manifest(parts, conversation_recordings(parts))


@query(f"WITH {_SEGMENTS_SQL} SELECT recording_id, segment_index, reason_code FROM judged")
def m1_validate_segment(spark, sf_dir):
    parts = conversation_segments(spark, sf_dir)
    return segments.validate(parts.join(conversation_recordings(parts), "recording_id")).select("recording_id", "segment_index", "reason_code")


@query(
    f"""WITH {_SEGMENTS_SQL} SELECT recording_id, segment_index, "start", "end", "end" - "start" AS duration, cleaned AS text,
    'audio/' || recording_id || '.wav' AS audio_path FROM judged WHERE reason_code = 'OK'"""
)
def m2_manifest_valid(spark, sf_dir):
    return _judged(spark, sf_dir)[0]


@query(
    f"""WITH {_SEGMENTS_SQL} SELECT recording_id, segment_index, reason_code,
    CASE WHEN reason_code <> 'unknown_audio_duration' THEN text END AS original_text FROM judged WHERE reason_code <> 'OK'"""
)
def m2_manifest_rejected(spark, sf_dir):
    return _judged(spark, sf_dir)[1].drop("reason")


@query(
    f"""WITH {_SEGMENTS_SQL}, v AS (SELECT *, "end" - "start" AS d, len({_tokens_sql("cleaned")}) AS w FROM judged WHERE reason_code = 'OK')
    SELECT (SELECT count(*) FROM judged) AS total_segments_processed, count(*) AS valid_segments,
    (SELECT count(*) FROM judged WHERE reason_code <> 'OK') AS rejected_segments, round(sum(d) / 3600, 6) AS total_audio_hours, min(d) AS min_seconds, max(d) AS max_seconds,
    round(avg(d), 6) AS mean_seconds, list_sort(list(d))[(count(*) // 2) + 1] AS median_seconds, min(w)::INTEGER AS min_words, max(w)::INTEGER AS max_words,
    round(avg(w), 6) AS mean_words, count(DISTINCT recording_id) AS unique_recordings,
    round(count(*) / (SELECT count(*) FROM judged) * 100, 6) AS acceptance_percent FROM v"""
)
def m3_health_report(spark, sf_dir):
    found = segments.health(*_judged(spark, sf_dir))
    rounded = ("total_audio_hours", "mean_seconds", "mean_words", "acceptance_percent")
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    f"""WITH {_SEGMENTS_SQL} SELECT CASE WHEN "end" - "start" < 1 THEN '<1s' WHEN "end" - "start" < 5 THEN '1-5s' WHEN "end" - "start" < 10 THEN '5-10s'
    WHEN "end" - "start" < 20 THEN '10-20s' WHEN "end" - "start" < 30 THEN '20-30s' ELSE '>30s' END AS bucket, count(*) AS n
    FROM judged WHERE reason_code = 'OK' GROUP BY 1"""
)
def m3_duration_distribution(spark, sf_dir):
    return segments.duration_distribution(_judged(spark, sf_dir)[0])


@query(f"WITH {_SEGMENTS_SQL} SELECT reason_code, count(*) AS n FROM judged WHERE reason_code <> 'OK' GROUP BY 1")
def m3_rejection_reasons(spark, sf_dir):
    return segments.rejection_reasons(_judged(spark, sf_dir)[1])


@query(
    f"""WITH {_SEGMENTS_SQL}, b AS (SELECT CASE WHEN "end" - "start" < 1 THEN '<1s' WHEN "end" - "start" < 5 THEN '1-5s' WHEN "end" - "start" < 10 THEN '5-10s'
    WHEN "end" - "start" < 20 THEN '10-20s' WHEN "end" - "start" < 30 THEN '20-30s' ELSE '>30s' END AS bucket, count(*) AS n
    FROM judged WHERE reason_code = 'OK' GROUP BY 1)
    SELECT bucket, lpad(bucket, 8, ' ') || ': ' || lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INTEGER, ' ') || '  ' || repeat('█', least(n, 50)) AS line FROM b"""
)
def m4_health_lines(spark, sf_dir):
    return transcripts.bucket_lines(segments.duration_distribution(_judged(spark, sf_dir)[0]))


@query(
    f"""WITH {_SEGMENTS_SQL}, r AS (SELECT reason_code, count(*) AS n FROM judged WHERE reason_code <> 'OK' GROUP BY 1)
    SELECT (row_number() OVER (ORDER BY n DESC, reason_code))::INTEGER AS rank, reason_code,
    lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INTEGER, ' ') || '  ' || reason_code AS line FROM r"""
)
def m4_reason_lines(spark, sf_dir):
    return transcripts.reason_lines(_judged(spark, sf_dir)[1])


@query(
    "SELECT CASE WHEN k = 1 THEN 'train' ELSE 'validation' END AS fold, CASE WHEN k = 1 THEN (n * 9) // 10 ELSE n - (n * 9) // 10 END AS n "
    "FROM (SELECT count(*) AS n FROM conversations), range(1, 3) AS t(k)"
)
def m5_split_manifest(spark, sf_dir):
    return segments.split(conversation_segments(spark, sf_dir), ["recording_id", "segment_index"]).groupBy("fold").agg(F.count("*").alias("n"))


_LIMITS = [
    (1, -0.1, 2.0, 10.0, "x"), (2, 3.0, 3.0, 10.0, "x"), (3, 9.0, 11.0, 10.0, "x"), (4, 9.0, 11.01, 10.0, "x"), (5, 0.0, 0.49, 10.0, "x"),
    (6, 0.0, 0.5, 10.0, "x"), (7, 0.0, 30.0, 60.0, "x"), (8, 0.0, 30.01, 60.0, "x"), (9, 0.0, 2.0, 10.0, "।।..."), (10, 0.0, 2.0, -1.0, "x"),
    (11, None, 2.0, 10.0, "x"), (12, 0.0, None, 10.0, "x"), (13, 0.0, 2.0, 10.0, None),
]
_LIMITS_CODES = (
    "negative_start end_le_start OK end_gt_duration too_short OK OK too_long text_too_short unknown_audio_duration negative_start end_le_start text_too_short"
).split()


@query(f"SELECT * FROM {values([(k + 1, c) for k, c in enumerate(_LIMITS_CODES)])} AS t(id, reason_code)")
def m1_limits(spark, sf_dir):
    rows = spark.createDataFrame(_LIMITS, "id int, start double, end double, audio_duration double, text string")
    return segments.validate(rows).select("id", "reason_code")


# --- disfluency ------------------------------------------------------------------------------

_FIRST: dict[str, str] = {}
for _category, _rank, _marker in disfluency.lexicon_rows():
    _FIRST.setdefault(_marker, _category)

_DETECT_SQL = f"""
marks AS (SELECT * FROM {values([(m, c, list(fixed.MARKERS).index(c)) for m, c in _FIRST.items()])} AS t(marker, category, rank)),
words AS (SELECT id, k, w[k] AS word, lower(w[k]) AS low, {_token_clean_sql("w[k]")} AS clean, w
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT id, {_tokens_sql("nfc_normalize(text)")} AS w FROM src))),
near AS (SELECT *, lead(clean, 1) OVER p AS c1, lead(clean, 2) OVER p AS c2, lead(clean, 3) OVER p AS c3, lead(word, 1) OVER p AS w1
  FROM words WINDOW p AS (PARTITION BY id ORDER BY k)),
chars AS (SELECT id, k, word, i, substr(word, i, 1) AS c FROM (SELECT id, k, word, unnest(range(1, length(word) + 1)) AS i FROM words)),
runs AS (SELECT id, k, word, c, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, k, c ORDER BY i) AS g FROM chars) GROUP BY id, k, word, c, g HAVING count(*) >= 3),
found AS (
  SELECT n.id, 'filler' AS type, arg_min(m.category, m.rank) AS category, n.word AS detected_text, n.k - 1 AS place, NULL AS repeat_count
    FROM near n JOIN marks m ON n.clean = m.marker OR n.low = m.marker GROUP BY n.id, n.k, n.word
  UNION ALL SELECT id, 'word_repetition', 'repetition', word, k - 1, NULL FROM near WHERE clean = c1 AND length(clean) > 1
  UNION ALL SELECT id, 'phrase_repetition', 'repetition', word || ' ' || w1, k - 1, NULL FROM near WHERE clean || ' ' || c1 = c2 || ' ' || c3
  UNION ALL SELECT id, 'prolongation', 'prolongation', word, k - 1, n FROM runs
  UNION ALL SELECT id, 'false_start', 'false_start', text, NULL, NULL FROM src WHERE regexp_matches(text, '\\.\\.|—|–') AND len({_tokens_sql("text")}) > 0
  UNION ALL SELECT id, 'false_start', 'false_start', text, NULL, NULL FROM src WHERE len({_tokens_sql("text")}) BETWEEN 1 AND 2)
"""


def _turns(spark, sf_dir):
    return conversation_segments(spark, sf_dir)


_TURNS_SQL = f"WITH src AS (SELECT conv_id::VARCHAR || '_seg' || turn AS id, text FROM conversations), {_DETECT_SQL}"
_LINES_SQL = f"WITH src AS (SELECT doc_id::VARCHAR || '_seg0' AS id, text FROM documents), {_DETECT_SQL}"


@query(f"{_TURNS_SQL} SELECT id AS segment_id, type AS disfluency_type, category AS disfluency_category, detected_text, place::INTEGER AS place, repeat_count::INTEGER AS repeat_count FROM found")
def d8_disfluency_pipeline(spark, sf_dir):
    found = disfluency.detect(_turns(spark, sf_dir))
    return found.select("segment_id", "disfluency_type", "disfluency_category", "detected_text", F.get("positions", F.lit(0)).alias("place"), "repeat_count")


def _documents_as_segments(spark, sf_dir):
    times = (F.lit(0).alias("segment_index"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("recording_id"), *times, "text")


@query(f"{_LINES_SQL} SELECT type AS disfluency_type, category AS disfluency_category, count(*) AS n FROM found GROUP BY 1, 2")
def d7_document_disfluencies(spark, sf_dir):
    found = disfluency.detect(_documents_as_segments(spark, sf_dir))
    return found.groupBy("disfluency_type", "disfluency_category").agg(F.count("*").alias("n"))


@query(f"{_TURNS_SQL} SELECT type AS disfluency_type, category AS disfluency_category, count(*) AS n FROM found GROUP BY 1, 2")
def d9_disfluency_summary(spark, sf_dir):
    found = disfluency.detect(_turns(spark, sf_dir))
    return found.groupBy("disfluency_type", "disfluency_category").agg(F.count("*").alias("n"))


@query(
    f"""{_TURNS_SQL} SELECT (SELECT count(*) FROM src) AS total_segments, count(*)::BIGINT AS total_detections, count(DISTINCT id) AS segments_with_disfluency,
    round(count(*) / (SELECT count(*) FROM src) * 100, 6) AS detections_per_100_segments,
    round(count(DISTINCT id) / (SELECT count(*) FROM src) * 100, 6) AS segment_rate_percent FROM found"""
)
def d10_segment_rates(spark, sf_dir):
    found = disfluency.rates(_turns(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("detections_per_100_segments", "segment_rate_percent")})


_SPOKEN = [
    (k + 1, s)
    for k, s in enumerate(
        [
            "उम मैं जा रहा हूं", "मैं मैं सोच रहा था", "सोोोोच रहा था", "मैं... मतलब वो बात है", "actually बस ये करना है", "अच्छा ठीक है फिर", "हाँ",
            "आज मौसम बहुत अच्छा है और हम बाहर जाएंगे", "मैं सोच मैं सोच रहा था", "see 1000 uh", "", "   ", None, "you know what", "तो चलो अब", "a a",
            "Um, UM. um!", "हां ok now", "x — y z", "I mean so so so", "aaa bbb aaa bbb", "....",
        ]
    )
]


@query(
    f"""WITH src AS (SELECT id, text FROM {values(_SPOKEN)} AS t(id, text)), {_DETECT_SQL}
    SELECT id, type AS disfluency_type, category AS disfluency_category, detected_text, place::INTEGER AS place, repeat_count::INTEGER AS repeat_count FROM found"""
)
def d_spoken_fixture(spark, sf_dir):
    rows = spark.createDataFrame(_SPOKEN, "id int, text string").select("id", F.explode(disfluency.detections(F.col("text"))).alias("d"))
    return rows.select(
        "id",
        F.col("d.type").alias("disfluency_type"),
        F.col("d.category").alias("disfluency_category"),
        F.col("d.detected_text").alias("detected_text"),
        F.get("d.positions", F.lit(0)).alias("place"),
        F.col("d.repeat_count").alias("repeat_count"),
    )


def _of_type(name: str) -> None:
    """Register the detector of one type over documents, counted by document and category."""
    sql = f"{_LINES_SQL} SELECT id AS segment_id, category AS disfluency_category, count(*) AS n FROM found WHERE type = '{name}' GROUP BY 1, 2"

    def detector(spark, sf_dir):
        found = disfluency.detect(_documents_as_segments(spark, sf_dir)).where(F.col("disfluency_type") == name)
        return found.groupBy("segment_id", "disfluency_category").agg(F.count("*").alias("n"))

    label = {"filler": "d1", "word_repetition": "d2", "phrase_repetition": "d3", "prolongation": "d4", "false_start": "d6"}[name]
    detector.__name__ = f"{label}_{name}"
    query(sql)(detector)


for _name in ("filler", "word_repetition", "phrase_repetition", "prolongation", "false_start"):
    _of_type(_name)


_BROKEN = [(k + 1, s) for k, s in enumerate(["wait... what is", "a — b c", "so – no yes", "a.. b c", "a. b. c.", "one two", "one", "  ", "x...", None])]


@query(
    f"""WITH s AS (SELECT id, text, len({_tokens_sql("text")}) AS n FROM {values(_BROKEN)} AS t(id, text))
    SELECT id, 'interruption_punctuation' AS marker FROM s WHERE n > 0 AND (contains(text, '..') OR contains(text, '—') OR contains(text, '–'))
    UNION ALL SELECT id, 'very_short_utterance' FROM s WHERE n BETWEEN 1 AND 2"""
)
def d5_interruptions(spark, sf_dir):
    rows = spark.createDataFrame(_BROKEN, "id int, text string").select("id", F.explode(disfluency.detections(F.col("text"))).alias("d"))
    return rows.where("d.type = 'false_start'").select("id", "d.marker")


@query(
    f"""{_TURNS_SQL}, {_SEGMENTS_SQL.strip().rstrip(",")} SELECT DISTINCT recording_id, recording_id || '_seg_' || printf('%.2f', "start") || '_' || printf('%.2f', "end") || '.wav' AS clip_name
    FROM segments WHERE "end" > "start" AND recording_id || '_seg' || segment_index IN (SELECT id FROM found)"""
)
def d12_batch_clips(spark, sf_dir):
    return disfluency.clips(disfluency.detect(_turns(spark, sf_dir))).select("recording_id", "clip_name")


@query(f"SELECT category, marker FROM {values([(c, m) for c, _, m in disfluency.lexicon_rows()])} AS t(category, marker)")
def s14_disfluency_lexicon(spark, sf_dir):
    return disfluency.lexicon(spark).select("category", "marker")


@query(f"SELECT DISTINCT marker FROM {values([(m,) for _, _, m in disfluency.lexicon_rows()])} AS t(marker)")
def s14_all_markers(spark, sf_dir):
    return disfluency.all_markers(disfluency.lexicon(spark))


@query(f"SELECT DISTINCT category FROM {values([(c,) for c in fixed.MARKERS])} AS t(category)")
def s14_categories(spark, sf_dir):
    return disfluency.categories(disfluency.lexicon(spark))


@query(
    f"""WITH {_SEGMENTS_SQL} SELECT recording_id, segment_index, CASE WHEN "end" > "start" THEN
    recording_id || '_seg_' || printf('%.2f', "start") || '_' || printf('%.2f', "end") || '.wav' END AS clip_name FROM segments"""
)
def d11_clip_names(spark, sf_dir):
    return disfluency.clip_names(conversation_segments(spark, sf_dir)).select("recording_id", "segment_index", "clip_name")


# --- spelling ---------------------------------------------------------------------------------

_WORDS_SQL = f"list_transform({_tokens_sql('text')}, lambda w: nfc_normalize(w))"


def _vocabulary(spark, sf_dir, name: str) -> DataFrame:
    """Tokens of whole texts, in normal form."""
    words = F.explode(text.tokens(F.col("text"))).alias("word")
    return table(spark, sf_dir, name).select(words).select(text.nfc(F.col("word")).alias("word"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM documents) GROUP BY word")
def p8_build_frequency(spark, sf_dir):
    return spelling.frequencies(_vocabulary(spark, sf_dir, "documents"))


#: Letters beyond ASCII in the tables: DuckDB's distance counts bytes, so SQL writes each as one byte.
_BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_ONE_BYTE = "||".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27 + len(_BEYOND) - 21)])


def _distance_sql(a: str, b: str) -> str:
    return "levenshtein(" + ", ".join(f"translate({x}, '{_BEYOND}', {_ONE_BYTE})" for x in (a, b)) + ")"


_NEAR_SQL = f"""
words AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS word FROM conversations),
book AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS word FROM benchmark),
pairs AS (SELECT w.word, b.word AS candidate, {_distance_sql('w.word', 'b.word')} AS distance FROM words w JOIN book b
  ON abs(length(w.word) - length(b.word)) <= 2 WHERE {_distance_sql('w.word', 'b.word')} <= 2)
"""


def _near(spark, sf_dir):
    return _vocabulary(spark, sf_dir, "conversations").distinct(), _vocabulary(spark, sf_dir, "benchmark").distinct()


@query(
    f"""WITH {_NEAR_SQL} SELECT word, candidate, distance::INTEGER AS distance, rank::INTEGER AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, candidate) AS rank FROM pairs) WHERE rank <= 5"""
)
def p9_edit_candidates(spark, sf_dir):
    return spelling.candidates(*_near(spark, sf_dir))


_SUFFIX_SQL = values([(s,) for s in dict.fromkeys(fixed.SUFFIXES)])
_CASCADE_SQL = f"""
WITH {_NEAR_SQL}, nearest AS (SELECT word, min(distance) AS distance, arg_min(candidate, (distance, candidate)) AS candidate FROM pairs GROUP BY word),
counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM conversations) GROUP BY word),
out AS (SELECT w.word, CASE WHEN b.word IS NOT NULL THEN 1 WHEN p.distance = 1 THEN 4 WHEN c.n >= 5 THEN 40 ELSE 5 END AS stage, p.candidate, p.distance
  FROM words w LEFT JOIN book b USING (word) LEFT JOIN nearest p USING (word) LEFT JOIN counts c USING (word))
SELECT word, CASE WHEN stage IN (1, 40) THEN 'correct_spelling' ELSE 'incorrect_spelling' END AS classification,
  CASE stage WHEN 1 THEN 'correct' WHEN 40 THEN 'correct' WHEN 4 THEN 'incorrect' ELSE 'uncertain' END AS detailed_classification,
  CASE stage WHEN 40 THEN 4 ELSE stage END::INTEGER AS layer, CASE WHEN stage IN (4, 5) THEN coalesce(candidate, '') ELSE '' END AS suggestion
FROM out
"""


def _cascade(spark, sf_dir):
    words, book = _near(spark, sf_dir)
    verdicts = spelling.classify_distinct(words, book, spelling.frequencies(_vocabulary(spark, sf_dir, "conversations")))
    label = F.when(F.col("classification") == "correct", F.lit("correct_spelling")).otherwise(F.lit("incorrect_spelling"))
    return verdicts.withColumn("detailed_classification", F.col("classification")).withColumn("classification", label)


@query(_CASCADE_SQL)
def p10_spelling_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).select("word", "classification", "detailed_classification", "layer", "suggestion")


@query(f"SELECT 'layer_' || layer AS layer, count(*) AS n FROM ({_CASCADE_SQL}) GROUP BY 1")
def p11_layer_summary(spark, sf_dir):
    return spelling.by_layer(_cascade(spark, sf_dir))


@query(f"SELECT classification, count(*) AS n FROM ({_CASCADE_SQL}) GROUP BY 1")
def p11_label_summary(spark, sf_dir):
    return spelling.by_label(_cascade(spark, sf_dir))


_HINDI = [
    ("मैं", "correct", 1, ""), ("करता", "correct", 1, ""), ("स्कूल", "correct", 1, ""), ("कंप्यूटर", "correct", 1, ""), ("खानाा", "correct", 2, ""),
    ("जाताा", "correct", 2, ""), ("चलाता", "correct", 2, ""), ("ामैं", "incorrect", 3, ""), ("क््षत्रिय", "incorrect", 3, ""), ("मैङ", "incorrect", 4, "मैं"),
    ("हैंं", "incorrect", 4, "हैं"), ("जानता", "incorrect", 4, "जाता"), ("देखते", "incorrect", 4, "देखता"), ("करत", "incorrect", 4, "औरत"),
    ("अवधारणा", "uncertain", 5, ""), ("computer", "uncertain", 5, ""), ("", "incorrect", 0, ""),
]


@query(f"SELECT * FROM {values(_HINDI)} AS t(word, classification, layer, suggestion)")
def p_hindi_fixture(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w, *_ in _HINDI], "word string")
    return spelling.classify_distinct(words, spelling.core_lexicon(spark)).drop("reason")


@query(
    f"""WITH lex AS (SELECT * FROM {values([(w,) for w in fixed.core_words()])} AS t(word)), suf AS (SELECT * FROM {_SUFFIX_SQL} AS t(suffix)),
    made AS (SELECT DISTINCT l.word || s.suffix AS word FROM lex l CROSS JOIN suf s WHERE length(l.word) < 6),
    cut AS (SELECT m.word, s.suffix, substr(m.word, 1, length(m.word) - length(s.suffix)) AS root FROM made m JOIN suf s ON suffix(m.word, s.suffix))
    SELECT c.word, arg_max(c.root, length(c.suffix)) AS root, arg_max(c.suffix, length(c.suffix)) AS suffix
    FROM cut c JOIN lex l ON l.word = c.root WHERE strlen(c.root) >= 6 GROUP BY c.word"""
)
def p3_morphology(spark, sf_dir):
    # every core word of under six characters with every suffix: a table made of two constants
    suffixes = F.array(*[F.lit(s) for s in dict.fromkeys(fixed.SUFFIXES)])
    words = spelling.core_lexicon(spark).where(F.length("word") < 6)
    made = words.select(F.explode(F.transform(suffixes, lambda s: F.concat(F.col("word"), s))).alias("word")).distinct()
    return spelling.inflections(made, spelling.core_lexicon(spark))


@query(f"SELECT suffix, length(suffix)::INTEGER AS n FROM {_SUFFIX_SQL} AS t(suffix)")
def s13_suffixes(spark, sf_dir):
    rows = [(x,) for x in dict.fromkeys(fixed.SUFFIXES)]
    return spark.createDataFrame(rows, "suffix string").select("suffix", F.length("suffix").alias("n"))


@query(
    f"""SELECT count(*) AS total_words, count(*) FILTER (WHERE classification = 'correct_spelling') AS correct_spelling,
    count(*) FILTER (WHERE classification = 'incorrect_spelling') AS incorrect_spelling,
    (SELECT string_agg(layer || '=' || n, ',' ORDER BY layer) FROM (SELECT 'layer_' || layer AS layer, count(*) AS n FROM ({_CASCADE_SQL}) GROUP BY 1)) AS layers FROM ({_CASCADE_SQL})"""
)
def s16_spelling_summary(spark, sf_dir):
    found = transcripts.spelling_summary(_cascade(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("by_layer"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("layers", shown).drop("by_layer")


@query(f"SELECT count(*) AS words, sum(CASE WHEN contains(word, ' ') THEN 1 ELSE 0 END)::BIGINT AS phrases FROM {values([(w,) for w in fixed.core_words()])} AS t(word)")
def s11_core_lexicon(spark, sf_dir):
    return spelling.core_lexicon(spark).agg(F.count("*").alias("words"), F.count_if(F.contains("word", F.lit(" "))).alias("phrases"))


@query(f"SELECT nfc_normalize(word) AS word, english FROM {values(list(fixed.TRANSLITERATIONS.items()))} AS t(word, english)")
def s12_transliterations(spark, sf_dir):
    return spelling.transliterations(spark)


@query(
    f"""SELECT word, min(doc_id * 100000 + k) AS ord FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k
    FROM (SELECT doc_id, {_tokens_sql("text")} AS w FROM documents)) GROUP BY word"""
)
def s9_ordered_distinct(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("k", "word"))
    return spelling.ordered_distinct(words.select("word", (F.col("doc_id") * 100000 + F.col("k") + 1).alias("ord")))


# --- alignment, error rates, lattice ------------------------------------------------------------

_SYSTEMS = 5


def benchmark_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text with five systems, which change, drop or double words by place."""
    words = text.tokens(text.normalize_for_wer(F.col("text")))

    def system(m: int):
        def word(w, k):
            kind = (k * 7 + m * 3 + F.col("item_id")) % 11
            return (
                F.when(((k * 5 + F.col("item_id")) % 13 == 4) & F.lit(m < 4), F.concat(w, F.lit("q")))
                .when((kind == 0) & (k % 2 == 0), F.lit("zz"))
                .when(kind == 1, F.lit(""))
                .when(kind == m + 2, F.concat(w, F.lit(" "), w))
                .when(kind == 8, F.concat(w, F.lit("x")))
                .otherwise(w)
            )

        heard = F.array_join(F.array_remove(F.transform(words, word), ""), " ")
        return F.struct(F.lit(m).alias("model_idx"), F.lit(f"system{m}").alias("name"), heard.alias("hyp"))

    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("utt_id"), F.col("text").alias("reference"), F.array(*[system(m) for m in range(_SYSTEMS)]).alias("models")
    )


_HEARD_SQL = f"""
items AS (SELECT item_id AS utt_id, {_tokens_sql(_wer_text_sql("text"))} AS ref FROM benchmark),
heard AS (SELECT utt_id, m AS model_idx, ref, {_tokens_sql(
    "array_to_string(list_filter(list_transform(ref, lambda w, i: CASE WHEN ((i - 1) * 5 + utt_id) % 13 = 4 AND m < 4 THEN w || 'q' WHEN ((i - 1) * 7 + m * 3 + utt_id) % 11 = 0 AND (i - 1) % 2 = 0 THEN 'zz' "
    "WHEN ((i - 1) * 7 + m * 3 + utt_id) % 11 = 1 THEN '' WHEN ((i - 1) * 7 + m * 3 + utt_id) % 11 = m + 2 THEN w || ' ' || w "
    "WHEN ((i - 1) * 7 + m * 3 + utt_id) % 11 = 8 THEN w || 'x' ELSE w END), lambda w: w <> ''), ' ')"
)} AS hyp FROM items, range(0, {_SYSTEMS}) AS r(m))
"""
#: The dynamic program row by row, then the way back, one step a recursion.
_ALIGN_SQL = """
dp AS (SELECT utt_id, model_idx, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS above, [range(0, len(hyp) + 1)] AS cost FROM {source}
  UNION ALL SELECT utt_id, model_idx, ref, hyp, i + 1, r.line, list_append(cost, r.line) FROM dp, LATERAL (SELECT list_reduce(
    list_transform(range(1, len(hyp) + 1), lambda j: [least(above[j + 1] + 1, above[j] + CASE WHEN hyp[j] = ref[i + 1] THEN 0 ELSE 1 END)]),
    lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1)), [i + 1]) AS line) r WHERE i < len(ref)),
tables AS (SELECT * FROM dp WHERE i = len(ref)),
back AS (SELECT utt_id, model_idx, ref, hyp, cost, len(ref) AS i, len(hyp) AS j, '' AS ops FROM tables
  UNION ALL SELECT utt_id, model_idx, ref, hyp, cost, i - CASE WHEN op IN ('C', 'S', 'D') THEN 1 ELSE 0 END, j - CASE WHEN op IN ('C', 'S', 'I') THEN 1 ELSE 0 END, op || ops
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND ref[i] = hyp[j] THEN 'C' WHEN i > 0 AND j > 0 AND cost[i + 1][j + 1] = cost[i][j] + 1 THEN 'S'
    WHEN i > 0 AND cost[i + 1][j + 1] = cost[i][j + 1] + 1 THEN 'D' ELSE 'I' END AS op FROM back WHERE i > 0 OR j > 0)),
aligned AS (SELECT utt_id, model_idx, ref, hyp, ops FROM back WHERE i = 0 AND j = 0)
"""


def _lines(spark, sf_dir):
    return lattice.aligned(benchmark_utterances(spark, sf_dir))


@query(f"WITH RECURSIVE {_HEARD_SQL}, {_ALIGN_SQL.format(source='heard')} SELECT utt_id, model_idx::INTEGER AS model_idx, ops FROM aligned")
def w1_align(spark, sf_dir):
    return _lines(spark, sf_dir).select("utt_id", F.inline("models")).select("utt_id", "model_idx", "ops")


_COUNT = "length(ops) - length(replace(ops, '{x}', ''))"
_METRICS_SQL = ", ".join(f"({_COUNT.format(x=x)})::INTEGER AS {n}" for x, n in zip("SDIC", ("substitutions", "deletions", "insertions", "correct")))


@query(
    f"""WITH RECURSIVE {_HEARD_SQL}, {_ALIGN_SQL.format(source='heard')} SELECT utt_id, model_idx::INTEGER AS model_idx, {_METRICS_SQL},
    len(ref)::INTEGER AS total_ref_words, (length(ops) - ({_COUNT.format(x="C")})) / greatest(len(ref), 1) AS wer FROM aligned"""
)
def w2_wer_metrics(spark, sf_dir):
    each = _lines(spark, sf_dir).select("utt_id", F.inline("models"))
    return each.select("utt_id", "model_idx", align.metrics(F.col("ops")).alias("m")).select("utt_id", "model_idx", "m.*")


_CELLS_SQL = f"""{_HEARD_SQL}, {_ALIGN_SQL.format(source="heard")},
steps AS (SELECT utt_id, model_idx, ref, hyp, ops, k, substr(ops, k, 1) AS o, k - 1 - length(replace(replace(replace(substr(ops, 1, k - 1), 'C', ''), 'S', ''), 'D', '')) AS ref_pos,
  k - length(replace(replace(replace(substr(ops, 1, k), 'C', ''), 'S', ''), 'I', '')) AS h FROM (SELECT *, unnest(range(1, length(ops) + 1)) AS k FROM aligned)),
cells AS (SELECT utt_id, ref_pos, o = 'I' AS is_insertion, model_idx, k, CASE WHEN o = 'I' THEN '<eps>' ELSE ref[ref_pos + 1] END AS ref_word,
  CASE WHEN o = 'D' THEN '<eps>' ELSE hyp[h] END AS word, CASE o WHEN 'C' THEN 'correct' WHEN 'S' THEN 'substitution' WHEN 'D' THEN 'deletion' ELSE 'insertion' END AS op FROM steps)
"""


@query(
    f"""WITH RECURSIVE {_CELLS_SQL}, keyed AS (SELECT *, CASE WHEN is_insertion THEN ref_pos || '_ins_' || model_idx ELSE ref_pos::VARCHAR END AS key FROM
      (SELECT utt_id, ref_pos, is_insertion, model_idx, max(ref_word) AS ref_word, arg_max(word, k) AS word, arg_max(op, k) AS op FROM cells GROUP BY utt_id, ref_pos, is_insertion, model_idx))
    SELECT utt_id, key, ref_pos::INTEGER AS ref_pos, is_insertion, max(ref_word) AS ref_word,
    array_to_string(list_transform(range(0, {_SYSTEMS}), lambda m: coalesce(map_from_entries(list((model_idx, word)))[m], '<eps>')), '|') AS model_words,
    array_to_string(list_transform(range(0, {_SYSTEMS}), lambda m: coalesce(map_from_entries(list((model_idx, op)))[m], '-')), '|') AS operations
    FROM keyed GROUP BY utt_id, key, ref_pos, is_insertion"""
)
def w4_position_lattice(spark, sf_dir):
    found = lattice.position_lattice(_lines(spark, sf_dir))
    shown = F.transform("operations", lambda o: F.coalesce(o, F.lit("-")))
    return found.withColumn("model_words", F.array_join("model_words", "|")).withColumn("operations", F.array_join(shown, "|"))


@query(
    f"""WITH RECURSIVE {_CELLS_SQL}, keyed AS (SELECT utt_id, ref_pos, model_idx, max(ref_word) AS ref_word, arg_max(word, k) AS word, arg_max(op, k) AS op FROM cells WHERE NOT is_insertion GROUP BY ALL)
    SELECT utt_id, ref_pos::VARCHAR AS key, lpad(ref_pos::VARCHAR, 8, ' ') || ' | ' || rpad(ref_word, greatest(12, length(ref_word))::INTEGER, ' ') || ' | ' ||
    string_agg(word, ' | ' ORDER BY model_idx) || ' | ' || string_agg(substr(op, 1, 3), ' | ' ORDER BY model_idx) AS line FROM keyed GROUP BY utt_id, ref_pos, ref_word"""
)
def w5_readable_lattice(spark, sf_dir):
    found = lattice.position_lattice(_lines(spark, sf_dir)).where("NOT is_insertion")
    return transcripts.lattice_lines(found).select("utt_id", "key", "line")


_VOTES_SQL = f"""{_CELLS_SQL},
voting AS (SELECT utt_id, ref_pos, ref_word, word, count(*) AS n, min(model_idx) AS first FROM cells WHERE NOT is_insertion GROUP BY ALL),
best AS (SELECT utt_id, ref_pos, any_value(ref_word) AS ref_word, arg_max(word, (n, -first)) FILTER (WHERE word <> '<eps>') AS word, coalesce(max(n) FILTER (WHERE word <> '<eps>'), 0) AS n
  FROM voting GROUP BY utt_id, ref_pos),
fixes AS (SELECT utt_id, ref_pos AS position, ref_word AS original_ref, word AS corrected_to, n || '/{_SYSTEMS}' AS agreement FROM best WHERE n >= 3 AND word <> ref_word)
"""


@query(f"WITH RECURSIVE {_VOTES_SQL} SELECT utt_id, position::INTEGER AS position, original_ref, corrected_to, agreement FROM fixes")
def w8_corrections(spark, sf_dir):
    found = lattice.corrections(lattice.voted(_lines(spark, sf_dir)))
    return found.select("utt_id", "position", "original_ref", "corrected_to", "agreement")


@query(f"WITH RECURSIVE {_VOTES_SQL} SELECT agreement, count(*) AS n FROM fixes GROUP BY agreement")
def w9_correction_analysis(spark, sf_dir):
    return lattice.correction_analysis(lattice.corrections(lattice.voted(_lines(spark, sf_dir))))


@query(
    f"""WITH RECURSIVE {_VOTES_SQL}, firsts AS (SELECT * FROM fixes ORDER BY utt_id, position LIMIT 10)
    SELECT (SELECT count(*) FROM fixes) AS total_corrections, CASE WHEN (SELECT count(*) FROM fixes) = 0 THEN '0%' END AS correction_rate,
    (SELECT string_agg(agreement || ': ' || n, ', ' ORDER BY agreement) FROM (SELECT agreement, count(*) AS n FROM fixes GROUP BY 1)) AS levels,
    (SELECT string_agg(utt_id || ':' || position || ' ' || original_ref || ' > ' || corrected_to, ', ' ORDER BY utt_id, position) FROM firsts) AS examples"""
)
def w9_correction_summary(spark, sf_dir):
    row = lattice.correction_summary(lattice.corrections(lattice.voted(_lines(spark, sf_dir))))
    levels = F.transform(F.map_entries("agreement_distribution"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    example = lambda x: F.concat(x["utt_id"].cast("string"), F.lit(":"), x["position"].cast("string"), F.lit(" "), x["original_ref"], F.lit(" > "), x["corrected_to"])
    return row.select(
        "total_corrections", "correction_rate", F.array_join(levels, ", ").alias("levels"), F.array_join(F.transform("examples", example), ", ").alias("examples")
    )


@query("SELECT 0::BIGINT AS total_corrections, '0%' AS correction_rate")
def w9_no_corrections(spark, sf_dir):
    none = lattice.corrections(lattice.voted(_lines(spark, sf_dir))).where("false")
    return lattice.correction_summary(none).select(F.col("total_corrections").cast("long").alias("total_corrections"), "correction_rate")


_LATTICE_SQL = (
    _VOTES_SQL
    + """,
fixed AS (SELECT b.utt_id, list(CASE WHEN b.n >= 3 THEN b.word ELSE b.ref_word END ORDER BY b.ref_pos) AS ref FROM best b GROUP BY b.utt_id),
again AS (SELECT h.utt_id, h.model_idx, f.ref, h.hyp FROM heard h JOIN fixed f USING (utt_id)),
"""
    + _ALIGN_SQL.format(source="again").replace("dp", "dp2").replace("tables", "tables2").replace("back", "back2").replace("aligned", "aligned2")
)


@query(
    f"""WITH RECURSIVE {_LATTICE_SQL} SELECT a.utt_id, a.model_idx::INTEGER AS model_idx, array_to_string(b.ref, ' ') AS corrected_reference,
    (length(a.ops) - ({_COUNT.format(x="C").replace("ops", "a.ops")})) / greatest(len(a.ref), 1) AS standard_wer,
    (length(b.ops) - ({_COUNT.format(x="C").replace("ops", "b.ops")})) / greatest(len(b.ref), 1) AS lattice_wer
    FROM aligned a JOIN aligned2 b USING (utt_id, model_idx)"""
)
def w10_evaluate_all_models(spark, sf_dir):
    scores, _ = transcripts.lattice_flow(benchmark_utterances(spark, sf_dir))
    return scores.select(
        "utt_id", "model_idx", "corrected_reference", F.col("standard.wer").alias("standard_wer"), F.col("lattice.wer").alias("lattice_wer")
    )


_REPORT_SQL = f"""WITH RECURSIVE {_LATTICE_SQL}, rates AS (SELECT a.utt_id, a.model_idx,
    round((length(a.ops) - ({_COUNT.format(x="C").replace("ops", "a.ops")})) / greatest(len(a.ref), 1) * 100, 6) AS s,
    round((length(b.ops) - ({_COUNT.format(x="C").replace("ops", "b.ops")})) / greatest(len(b.ref), 1) * 100, 6) AS l FROM aligned a JOIN aligned2 b USING (utt_id, model_idx))"""


@query(f"{_REPORT_SQL} SELECT utt_id, model_idx::INTEGER AS model_idx, CASE WHEN l < s THEN 'better' WHEN l = s THEN 'same' ELSE 'worse' END AS verdict FROM rates")
def w11_report(spark, sf_dir):
    scores, _ = transcripts.lattice_flow(benchmark_utterances(spark, sf_dir))
    line = F.col("line")
    verdict = F.when(line.contains("✅"), "better").when(line.contains("─"), "same").otherwise("worse")
    return transcripts.score_lines(scores).select("utt_id", "model_idx", verdict.alias("verdict"))


_RATES = [("base", 81.32, 58.03, 50), ("tuned", 23.5, 11.29, 50)]


@query(f"SELECT name, '| ' || name || ' | ' || printf('%.2f', wer) || ' | ' || printf('%.2f', cer) || ' | ' || n || ' |' AS line FROM {values(_RATES)} AS t(name, wer, cer, n)")
def w13_rate_table(spark, sf_dir):
    return transcripts.rate_lines(spark.createDataFrame(_RATES, "name string, wer double, cer double, num_samples int"))


_ALIGNED = [
    ("A B C", "A B C", "CCC"), ("A B C", "A X C", "CSC"), ("मैं जा रहा हूं", "मैं जाता हूं", "CDSC"), ("a b c d", "a x d", "CDSC"), ("a b", "a b c c", "CCII"),
    ("p q r", "q r s", "DCCI"), ("", "a b", "II"), ("a b", "", "DD"), ("", "", ""),
]


@query(f"SELECT * FROM {values(_ALIGNED)} AS t(reference, hypothesis, ops)")
def w1_align_fixture(spark, sf_dir):
    rows = spark.createDataFrame([x[:2] for x in _ALIGNED], "reference string, hypothesis string")
    return rows.withColumn("ops", align.align(text.tokens(F.col("reference")), text.tokens(F.col("hypothesis"))))


_BALLOTS = [("A A A B B", 3, "A", 3), ("A B C D E", 3, None, 1), ("<eps> <eps>", 3, None, 0), ("B A A B", 2, "B", 2), ("<eps> A <eps> A A", 3, "A", 3)]


@query(f"SELECT * FROM {values(_BALLOTS)} AS t(ballot, threshold, word, votes)")
def w7_consensus_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(b, t) for b, t, *_ in _BALLOTS], "ballot string, threshold int")
    cast = lambda t: lattice.consensus(F.split("ballot", " "), t)
    vote = F.when(F.col("threshold") == 2, cast(2)).otherwise(cast(3))
    return rows.select("ballot", "threshold", vote["word"].alias("word"), vote["votes"].alias("votes"))


def benchmark_samples(spark, sf_dir):
    first = benchmark_utterances(spark, sf_dir).select("utt_id", "reference", F.col("models.hyp").alias("hyps"))
    # every third hypothesis is the first system's for the next word order; every seventh is blank
    hyp = F.when(F.col("utt_id") % 7 == 0, F.lit("")).when(F.col("utt_id") % 3 == 0, F.reverse(F.get("hyps", F.lit(0)))).otherwise(F.get("hyps", F.lit(0)))
    return first.select(F.col("utt_id").alias("idx"), "reference", hyp.alias("hypothesis"))


_SAMPLES_SQL = f"""{_HEARD_SQL},
samples AS (SELECT utt_id AS idx, array_to_string(ref, ' ') AS reference, CASE WHEN utt_id % 7 = 0 THEN '' WHEN utt_id % 3 = 0 THEN reverse(array_to_string(hyp, ' '))
  ELSE array_to_string(hyp, ' ') END AS hypothesis FROM heard WHERE model_idx = 0),
pairs AS (SELECT idx AS utt_id, 0 AS model_idx, {_tokens_sql("reference")} AS ref, {_tokens_sql(_wer_text_sql("hypothesis"))} AS hyp FROM samples),
{_ALIGN_SQL.format(source="pairs")},
rated AS (SELECT utt_id AS idx, len(ref) AS n, length(ops) - ({_COUNT.format(x="C")}) AS errors, CASE WHEN len(hyp) = 0 THEN 1.0 ELSE (length(ops) - ({_COUNT.format(x="C")})) / len(ref) END AS sample_wer,
  {_distance_sql("array_to_string(ref, ' ')", "array_to_string(hyp, ' ')")} AS edits, length(array_to_string(ref, ' ')) AS chars FROM aligned)
"""


@query(f"WITH RECURSIVE {_SAMPLES_SQL} SELECT round(sum(errors) / sum(n) * 100, 6) AS wer, round(sum(edits) / sum(chars) * 100, 6) AS cer, count(*) AS num_samples, count(*) FILTER (WHERE sample_wer > 0.5) AS num_failures FROM rated")
def w6_corpus_wer(spark, sf_dir):
    return evaluate.summary(evaluate.prepared(benchmark_samples(spark, sf_dir))).select(F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "num_samples", "num_failures")


@query(
    f"""WITH RECURSIVE {_SAMPLES_SQL} SELECT idx, round(sample_wer, 9) AS sample_wer FROM rated WHERE sample_wer > 0.5
    ORDER BY printf('%.1f', sample_wer * 100) || '%' DESC, idx LIMIT 20"""
)
def w12_top_failures(spark, sf_dir):
    found = evaluate.failures(evaluate.prepared(benchmark_samples(spark, sf_dir)))
    return evaluate.top_failures(found).select("idx", F.round("sample_wer", 9).alias("sample_wer"))


@query(f"WITH RECURSIVE {_SAMPLES_SQL} SELECT round(sum(errors) / sum(n) * 100, 6) AS wer FROM rated")
def m6_compute_metrics(spark, sf_dir):
    normal = benchmark_samples(spark, sf_dir).select("idx", *[text.normalize_for_wer(F.col(c)).alias(c) for c in ("reference", "hypothesis")])
    return evaluate.training_metrics(normal).select(F.round("wer", 6).alias("wer"))


# --- sources and audio ---------------------------------------------------------------------------

_RECORDINGS = [(7, "r1", "given"), (0, "r2", "given"), (8, None, "x"), (9, "r4", None)]


@query(
    f"SELECT user_id, recording_id, rec_url_gcp AS audio_url, '{io.DEFAULT_BASE}/' || user_id || '/' || recording_id || '_transcription.json' AS transcription_url "
    f"FROM {values(_RECORDINGS)} AS t(user_id, recording_id, rec_url_gcp) WHERE user_id <> 0 AND recording_id IS NOT NULL"
)
def s5_recording_urls(spark, sf_dir):
    rows = spark.createDataFrame(_RECORDINGS, "user_id int, recording_id string, rec_url_gcp string")
    return io.urls(rows).select("user_id", "recording_id", "audio_url", "transcription_url")


@query("SELECT conv_id::VARCHAR AS recording_id, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn * 0.5::DOUBLE) AS last FROM conversations GROUP BY 1")
def s4_parse_transcripts(spark, sf_dir):
    one = F.struct((F.col("turn") * 0.5).alias("start"), (F.col("turn") * 0.5 + 0.4).alias("end"), F.lit(1).alias("speaker_id"), "text")
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("recording_id")).agg(F.to_json(F.collect_list(one)).alias("content"))
    rows = io.parse_transcripts(files)
    return rows.groupBy("recording_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("start").alias("last"))


_CLIPS_SQL = f"""WITH {_SEGMENTS_SQL}, b AS (SELECT recording_id, segment_index, trunc(greatest(0.0, "start" - 0.1::DOUBLE) * 16000)::BIGINT AS first,
  trunc(least(audio_duration, "end" + 0.1::DOUBLE) * 16000)::BIGINT AS last, trunc(audio_duration * 16000)::BIGINT AS total FROM segments JOIN recordings USING (recording_id))
SELECT recording_id, segment_index, CASE WHEN least(last, total) > first THEN first END AS first, CASE WHEN least(last, total) > first THEN last END AS last FROM b"""


@query(_CLIPS_SQL)
def a4_clip_bounds(spark, sf_dir):
    parts = conversation_segments(spark, sf_dir)
    both = parts.join(conversation_recordings(parts), "recording_id")
    bounds = audio.clip_bounds(F.col("start"), F.col("end"), F.col("audio_duration"))
    return both.select("recording_id", "segment_index", bounds["first"].alias("first"), bounds["last"].alias("last"))


_FILES = [(1, False, 5, 1.0), (2, True, 0, 1.0), (3, True, 5, -1.0), (4, True, 5, 7200.0), (5, True, 5, 7200.5), (6, True, 5, None)]


@query("SELECT * FROM (VALUES (1, 'File does not exist'), (2, 'File is empty'), (3, 'Cannot determine duration or zero-length'), (4, 'OK'), (5, 'Unusually long'), (6, 'Cannot determine duration or zero-length')) AS t(id, verdict)")
def a6_audio_checks(spark, sf_dir):
    rows = spark.createDataFrame(_FILES, "id int, present boolean, size long, duration double")
    return rows.select("id", audio.file_check(F.col("present"), F.col("size"), F.col("duration")).alias("verdict"))
