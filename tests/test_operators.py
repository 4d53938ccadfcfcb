"""Operators against independent statements of their rules, fixtures and round trips."""

import io as bytesio
import json
import math
import random
import unicodedata
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaakya.functions import devanagari, fixed, text
from vaakya.operators import align, audio, disfluency, evaluate, lattice, segments, spelling
from vaakya.plans import transcripts
from vaakya.sources import io

ODD = "aZé क़नुं़्।॥,.?!-–—…²½_ \t\n\x1c\x85\xa0 १😀İΣ"


def column(spark, values, *columns):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "  "]


def test_text_functions_on_noise(spark, noise):
    v = F.col("v")
    got = column(spark, noise, text.nfc(v), text.tokens(v), text.count_words(v), text.clean_text(v))
    for value, (nfc, words, n, cleaned) in zip(noise, got):
        if value is not None:
            assert nfc == unicodedata.normalize("NFC", value)
        assert words == (value or "").split() and n == len(words)
        assert cleaned == " ".join(cleaned.split())


def test_unicode_normalisation_cases(spark):
    assert column(spark, ["क़", "ऩ", "é"], text.nfc(F.col("v"))) == [("क़",), ("ऩ",), ("é",)]


def test_fixed_point(spark):
    frame = spark.createDataFrame([(0.25, "0.2"), (0.35, "0.4"), (-1.0, "-1.0"), (97.44, "97.4")], "x double, s string")
    assert all(r[0] == r[1] for r in frame.select(text.fixed_point(F.col("x"), 1), "s").collect())


def test_fault_reasons(spark):
    words = ["ामैं", "क््ष", "खानाा", "़क", "्क", "अ़", "क", ""]
    got = [r[0] for r in column(spark, words, devanagari.fault_reason(F.col("v")))]
    assert got == [
        "Word starts with matra 'ा'",
        "Virama at position 2 doesn't follow consonant (preceded by '्')",
        "Consecutive matras at position 3: 'ा' + 'ा'",
        "Word starts with nukta",
        "Word starts with virama",
        "Nukta at position 1 doesn't follow consonant",
        "Valid Devanagari sequence",
        "Empty word",
    ]


# --- segments


def test_reasons_carry_values(spark):
    rows = [(-0.1, 2.0, 10.0, "x"), (3.0, 3.0, 10.0, "x"), (0.0, 0.25, 10.0, "x"), (9.0, 11.5, 10.0, "x"), (0.0, 2.0, 10.0, "..."), (0.0, 2.0, 0.0, "x")]
    frame = spark.createDataFrame(rows, "start double, end double, audio_duration double, text string")
    assert [r["reason"] for r in segments.validate(frame).collect()] == [
        "Negative start time: -0.1",
        "end (3.0) <= start (3.0)",
        "Too short: 0.25s < 0.5s",
        "end (11.5) > audio_duration (10.0)",
        "Text too short after cleaning: ''",
        "Cannot determine audio duration",
    ]


def test_health_of_nothing(spark):
    valid = spark.createDataFrame([], "recording_id string, duration double, text string")
    rejected = spark.createDataFrame([], "recording_id string")
    row = transcripts.acceptance(segments.health(valid, rejected)).first()
    assert row["acceptance_rate"] == "N/A" and row["median_seconds"] == "N/A" and row["min_words"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50])
def test_upper_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.5, 1.0, 1.5, 2.25, 7.0, 7.5]) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in values], "d double")
    assert segments.upper_median(frame, "d").first()["median"] == sorted(values)[n // 2]


def test_split_sizes(spark):
    frame = spark.range(137).withColumnRenamed("id", "k")
    got = {r["fold"]: r["count"] for r in segments.split(frame, ["k"]).groupBy("fold").count().collect()}
    assert got == {"train": int(137 * 0.9), "validation": 137 - int(137 * 0.9)}


# --- disfluency


def test_missing_ids(spark):
    frame = spark.createDataFrame([(3, None, None, "um hello there")], "row int, recording_id string, segment_index int, text string")
    frame = frame.withColumns({"start": F.lit(0.0), "end": F.lit(1.0)})
    row = disfluency.detect(frame).first()
    assert (row["recording_id"], row["segment_id"]) == ("unknown_3", "unknown_3_seg3")


def test_detection_order(spark):
    (found,) = column(spark, ["मैं... मतलब वो बात है"], disfluency.detections(F.col("v")))[0]
    assert [(d["type"], d["category"]) for d in found] == [
        ("filler", "hesitation"), ("filler", "hesitation"), ("prolongation", "prolongation"), ("false_start", "false_start"),
    ]
    assert found[2]["character"] == "." and found[2]["repeat_count"] == 3 and found[3]["marker"] == "interruption_punctuation"


def test_stream_of_segments(spark, tmp_path):
    from vaakya.streaming.detect import counts

    spark.createDataFrame([("2024-01-01 00:00:05", "um um hello"), ("2024-01-01 00:01:05", "er yes no")], "t string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, text string").json(str(tmp_path / "in")).withColumn("event_time", F.col("t").cast("timestamp"))
    run = counts(stream).writeStream.format("memory").queryName("found").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = sorted((str(r["window"]["start"])[11:16], r["disfluency_type"], r["count"]) for r in spark.table("found").collect())
    assert got == [("00:00", "filler", 2), ("00:00", "word_repetition", 1), ("00:01", "filler", 1)]


# --- spelling


def test_edit_distance_against_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n: sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(n)})
    words, book = make(60), make(40)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    frames = [spark.createDataFrame([(w,) for w in x], "word string") for x in (words, book)]
    for most in (1, 2):
        got = {tuple(r) for r in spelling.near_words(*frames, most).collect()}
        assert got == {(a, b, d) for a in words for b in book if (d := distance(a, b)) <= most}


def test_frequency_stage(spark):
    words = spark.createDataFrame([("अवधारणा",)] * 5 + [("विश्वविद्यालय",)] * 4 + [(None,), (" ",)], "word string")
    got = {(r["word"], r["detailed_classification"], r["layer"]) for r in spelling.classify(words, spelling.core_lexicon(spark)).collect()}
    assert got == {("अवधारणा", "correct", 4), ("विश्वविद्यालय", "uncertain", 5), (None, "incorrect", 0), (" ", "incorrect", 0)}


# --- alignment and lattice


def slow_operations(ref, hyp):
    n, m = len(ref), len(hyp)
    cost = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = ref[i - 1] == hyp[j - 1]
            cost[i][j] = min(cost[i - 1][j - 1] + (not same), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    ops = ""
    i, j = n, m
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            ops, i, j = "C" + ops, i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            ops, i, j = "S" + ops, i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            ops, i = "D" + ops, i - 1
        else:
            ops, j = "I" + ops, j - 1
    return ops


def test_operations_on_random_pairs():
    rng = random.Random(1)
    for _ in range(500):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert align.operations(ref, hyp) == slow_operations(ref, hyp)


def utterance(spark, reference, hyps):
    models = [(k, f"m{k}", h) for k, h in enumerate(hyps)]
    return spark.createDataFrame([("u", reference, models)], f"utt_id string, reference string, models {lattice.MODELS}")


def test_lattice_flow(spark):
    hyps = ["मैं जाता हूं"] * 4 + ["मैं जाती हूं"]
    scores, fixes = transcripts.lattice_flow(utterance(spark, "मैं जाती हूं।", hyps))
    rows = scores.orderBy("model_idx").collect()
    assert [round(r["standard"]["wer"], 9) for r in rows] == [round(1 / 3, 9)] * 4 + [0]
    assert [round(r["lattice"]["wer"], 9) for r in rows] == [0] * 4 + [round(1 / 3, 9)]
    (fix,) = fixes.collect()
    assert (fix["position"], fix["original_ref"], fix["corrected_to"], fix["agreement"]) == (1, "जाती", "जाता", "4/5")
    lines = [r["line"] for r in transcripts.score_lines(scores).orderBy("model_idx").collect()]
    assert "33.33%" in lines[0] and "-33.33% ✅" in lines[0] and "+33.33%" in lines[4]


def test_last_insertion_counts(spark):
    lines = lattice.aligned(utterance(spark, "a b", ["a x y b", "a b"]))
    assert [(r["nth"], r["word"]) for r in lattice.cells(lines).where("is_insertion").orderBy("nth").collect()] == [(0, "x"), (1, "y")]
    (row,) = lattice.position_lattice(lines).where("is_insertion").collect()
    assert (row["key"], row["model_words"], row["operations"]) == ("1_ins_0", ["y", "<eps>"], ["insertion", None])


def test_failures_order_by_text(spark):
    rows = [(1, "a", "b c d e f g h i j k"), (2, "a b", "a"), (3, "a b c d e", "a x x x x"), (4, " ", "x"), (5, "a b", "")]
    lines = evaluate.prepared(spark.createDataFrame(rows, "idx int, reference string, hypothesis string"))
    found = evaluate.failures(lines)
    assert [r["wer"] for r in evaluate.top_failures(found).collect()] == ["80.0%", "1000.0%", "100.0%"]
    assert [r["idx"] for r in evaluate.top_failures(found, numeric=True).collect()] == [1, 5, 3]


# --- sources


def test_transcripts_keep_valid_rows(spark):
    good = {"start": "1.5", "end": True, "text": "x", "speaker_id": 2}
    files = [
        ("a", json.dumps([good, {"start": 1, "end": 2}, {"start": "no", "end": 2, "text": "x"}, {"start": 1, "end": 2, "text": 5}, 7])),
        ("b", json.dumps({"start": 1})), ("c", "not json"), ("d", "[]"), ("e", None),
    ]
    got = io.parse_transcripts(spark.createDataFrame(files, "recording_id string, content string")).collect()
    assert [(r["recording_id"], r["segment_index"], r["start"], r["end"], r["speaker_id"], r["text"]) for r in got] == [("a", 0, 1.5, 1.0, 2, "x")]


def test_transcripts_are_named_by_their_files(spark, tmp_path):
    (tmp_path / "rec7_transcription.json").write_text(json.dumps([{"start": 0, "end": 1.5, "text": "um hello there"}]))
    (row,) = io.read_transcripts(spark, str(tmp_path)).collect()
    assert (row["recording_id"], row["segment_index"], row["end"], row["text"]) == ("rec7", 0, 1.5, "um hello there")
    files = spark.createDataFrame([("rec7", json.dumps([{"start": 0, "end": 1.5, "text": "um hello there"}, {"start": 2, "end": 2.1, "text": "x"}]))], "recording_id string, content string")
    recordings = spark.createDataFrame([("rec7", "a.wav", 9.0)], "recording_id string, audio_path string, audio_duration double")
    valid, rejected, health = transcripts.manifest_flow(files, recordings)
    assert valid.count() == 1 and rejected.first()["reason_code"] == "too_short" and health.first()["acceptance_percent"] == 50.0


def test_word_lists(spark, tmp_path):
    words = ["b", "a", "b", " c "]
    (tmp_path / "w.txt").write_text("\n".join([*words, "", " "]))
    (tmp_path / "w.json").write_text(json.dumps({"words": words}))
    (tmp_path / "x.json").write_text(json.dumps(words))
    (tmp_path / "w.csv").write_text("id,word\n" + "\n".join(f"{k},{w}" for k, w in enumerate(words)))
    for name in ("w.txt", "w.json", "x.json", "w.csv"):
        got = [r["word"] for r in io.read_words(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert got == ["b", "a", "c"], name
    assert io.read_lexicon(spark, str(tmp_path / "w.txt")).count() == 359 + 3


def test_flows_write_results(spark, tmp_path):
    manifest = spark.createDataFrame([("p", 'say "um", um', 1.0, 0.0, 1.0, "r", 0)], io.MANIFEST)
    io.write_manifest(manifest, str(tmp_path / "m"))
    transcripts.disfluency_flow(spark, str(tmp_path / "m"), str(tmp_path / "d"))
    got = spark.read.csv(str(tmp_path / "d"), header=True, escape='"', multiLine=True).collect()
    assert tuple(got[0].asDict()) == disfluency.OUTPUT and got[0]["transcript_text"] == 'say "um", um'
    assert not io.write_detections(disfluency.detect(manifest.where("false")), str(tmp_path / "none"))
    (tmp_path / "w.txt").write_text("मैं\nxyz")
    transcripts.spelling_flow(spark, str(tmp_path / "w.txt"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/details"), header=True).count() == 2
    (tmp_path / "u.json").write_text(json.dumps([{"reference": "a b", "models": {"m1": "a b", "m2": "a"}}]))
    (row,) = io.read_utterances(spark, str(tmp_path / "u.json")).collect()
    assert row["reference"] == "a b" and [m["hyp"] for m in row["models"]] == ["a b", "a"]
    (tmp_path / "o.json").write_text(json.dumps({"reference": "a", "models": {"zeta": "x", "alpha": "y", "mid": "z"}}))
    (row,) = io.read_utterances(spark, str(tmp_path / "o.json")).collect()
    assert [(m["model_idx"], m["name"], m["hyp"]) for m in row["models"]] == [(0, "zeta", "x"), (1, "alpha", "y"), (2, "mid", "z")]


def test_fetch_and_missing(spark):
    rows = io.urls(spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, recording_id string"))
    got = io.fetch(rows, lambda u: b"x" if u.endswith("a_recording.wav") else b"")
    assert tuple(io.batch_report(got).first()) == (1, 1, 2)
    assert [r["recording_id"] for r in io.missing(rows, rows.where("user_id = 1")).collect()] == ["b"]


# --- audio


def pcm(values, rate=16000, channels=1):
    out = bytesio.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.repeat(values, channels) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_round_trip(spark):
    tone = np.sin(np.arange(8000) / 20) * 0.5
    files = [(1, bytearray(pcm(tone))), (2, bytearray(pcm(tone[::2], 8000, 2))), (3, bytearray(b"junk")), (4, None)]
    frame = spark.createDataFrame(files, "k int, content binary")
    rows = frame.select("k", audio.duration("content").alias("d"), audio.load("content").alias("w")).orderBy("k").collect()
    assert [r["d"] for r in rows] == [0.5, 0.5, -1.0, -1.0]
    assert len(rows[0]["w"]) == len(rows[1]["w"]) == 8000 and rows[2]["w"] is None
    assert np.abs(np.array(rows[0]["w"]) - tone).max() < 1e-3
    cut = frame.where("k = 1").select(audio.clip("content", F.lit(0.2), F.lit(0.3)).alias("c"), audio.clip("content", F.lit(9.0), F.lit(9.5)).alias("e")).first()
    with wave.open(bytesio.BytesIO(bytes(cut["c"]))) as f:
        assert abs(f.getnframes() - 4800) <= 1 and f.getframerate() == 16000
    assert cut["e"] is None


def test_snr(spark):
    rng = np.random.default_rng(0)
    loud = np.concatenate([rng.normal(0, 0.01, 8000), rng.normal(0, 0.5, 8000)])
    frame = spark.createDataFrame([(loud.tolist(),), ([0.0] * 100,)], "w array<double>")
    got = [r[0] for r in frame.select(audio.snr(F.col("w"))).collect()]
    padded = np.pad(loud, 200)
    rms = np.sort([np.sqrt((padded[k * 160 : k * 160 + 400] ** 2).mean()) for k in range(1 + (len(padded) - 400) // 160)])
    tenth = max(1, len(rms) // 10)
    assert math.isclose(got[0], 20 * math.log10((rms[-tenth:].mean() + 1e-10) / (rms[:tenth].mean() + 1e-10)), rel_tol=1e-9)
    assert got[1] == float("-inf")


def test_fixed_values():
    assert len(fixed.core_words()) == 359 and len(fixed.SUFFIXES) == 46 and len(fixed.TRANSLITERATIONS) == 67


def test_alignment_of_long_texts(spark):
    """Rows of costs and pairs of words take space in proportion to a text, not to its square."""
    rng = random.Random(3)
    reference = [f"w{rng.randint(0, 400)}" for _ in range(20_000)]
    hypothesis = [w if rng.random() > 0.1 else rng.choice(("x", "w1")) for w in reference if rng.random() > 0.05]
    rows = spark.createDataFrame([(reference, hypothesis)], "r array<string>, h array<string>")
    ops = align.operations(reference, hypothesis)
    assert len(ops.replace("I", "")) == len(reference) and len(ops.replace("D", "")) == len(hypothesis)
    got = rows.select(align.pairs(F.col("r"), F.col("h"), F.lit(ops)).alias("p")).first()["p"]
    assert [p["ref"] for p in got if p["op"] != "insertion"] == reference
    assert [p["hyp"] for p in got if p["op"] != "deletion"] == hypothesis
    assert all((p["ref"] == p["hyp"]) == (p["op"] == "correct") for p in got)


def test_segments_of_unknown_recordings_are_rejected(spark):
    parts = spark.createDataFrame([("a", 0, 0.0, 2.0, "one"), ("b", 0, 0.0, 2.0, "two")], "recording_id string, segment_index int, start double, end double, text string")
    known = spark.createDataFrame([("a", "a.wav", 10.0)], "recording_id string, audio_path string, audio_duration double")
    valid, rejected = segments.manifest(parts, known)
    assert [r["recording_id"] for r in valid.collect()] == ["a"]
    assert [(r["recording_id"], r["reason_code"]) for r in rejected.collect()] == [("b", segments.UNKNOWN_AUDIO)]


def test_missing_ids_are_numbered(spark):
    rows = [(None, 0, "um"), ("r", 1, "fine words here"), (None, None, "uh")]
    parts = spark.createDataFrame(rows, "recording_id string, segment_index int, text string").coalesce(1)
    parts = parts.withColumns({"start": F.lit(0.0), "end": F.lit(1.0)})
    got = disfluency.detect(parts).where("disfluency_type = 'filler'").collect()
    assert [(r["recording_id"], r["segment_id"]) for r in got] == [("unknown_0", "unknown_0_seg0"), ("unknown_2", "unknown_2_seg2")]
