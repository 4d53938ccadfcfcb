"""The pipeline against a plain statement of its stages, and each stage's contract."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vaakya.llm import langid_rank, pii_bootstrap
from vaakya.llm.quality_gbdt import fold
from vaakya.llm.vocabularies import vocabulary

from .conftest import EDGES, SMALL
from .test_operators import links_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_stages(spark, rows):
    """Rows (doc_id, text) after each stage, all on the driver."""
    frame = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)
    profiles = langid_rank.learn(frame, fold(F.col("doc_id"), 4) != 2)
    kept = [(i, t) for i, t, _ in rows if profiles.predict(t)[0] != "und"]
    yield kept
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i, t in sorted(kept):
        first.setdefault(norm(t), i)
    kept = [(i, t) for i, t in kept if first[norm(t)] == i]
    yield kept
    heads = {i for i, _, head in links_by_hand(kept, 5, 80) if i == head}
    kept = [(i, t) for i, t in kept if i in heads]
    yield kept
    spans = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    out = []
    for i, t in kept:
        runs = []
        for span in filter(None, spans[i].split(",")):
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b, kind])
        for a, b, kind in reversed(runs):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        out.append((i, t))
    yield out


def test_stages_against_plain(spark, documents):
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.select("doc_id", "text", "lang").collect()]
    rows += [(10_000 + k, t, "en") for k, t in enumerate(EDGES)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    for (name, stage), expected in zip(pipeline.STAGES, plain_stages(spark, rows)):
        docs = stage(spark, docs, SMALL)
        assert tuple(docs.columns) == pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(expected), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = Counter()
    for i, t in expected:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            pieces[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert Counter(tuple(r)[:5] for r in got) == pieces


def test_rows_without_ids_stay(spark):
    """One row of each group stays, also where no row of it has a doc_id; ids win over none."""
    one, two = (" ".join(f"{w}{k}" for k in range(40)) for w in ("one", "two"))
    rows = [(None, one), (None, one), (3, two), (None, two), (None, "a text of its own"), (None, f"{one} more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    after = Counter((r["doc_id"], r["text"]) for r in pipeline.exact(spark, docs, SMALL).collect())
    assert after == Counter([(None, one), (3, two), (None, "a text of its own"), (None, f"{one} more")])
    left = Counter(r["text"] for r in pipeline.near(spark, pipeline.exact(spark, docs, SMALL), SMALL).collect())
    assert left[two] == left["a text of its own"] == 1 and left[one] + left[f"{one} more"] == 1


def test_run_and_stages_on_nothing(spark):
    assert pipeline.run(spark, SMALL).count() > 0
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
