"""A corpus pipeline over ``documents``; each stage is one operator of ``vaakya.llm``.

A stage takes the documents its predecessor kept, as rows with the columns of ``documents``,
and returns the same columns; the last one returns the packing plan.  Stages keep null and
empty texts apart from what their own decision says of them: language identification rejects
a text without a letter (null and empty ones too).  Rows without a doc_id are documents like
others, each of its own, and one stays where its group has no row with a doc_id; rows that
repeat a doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaakya.llm import exact_mph, langid_rank, packing_cg, pii_bootstrap, sigtree_join
from vaakya.llm.scratch import materialise
from vaakya.llm.vocabularies import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``nameless``: rows without a doc_id get numbers from the largest one down."""
    rows = docs.select(*COLUMNS)
    lost = rows.where("doc_id is null")
    found = rows.where("doc_id is not null").withColumn("nameless", F.lit(False))
    if lost.isEmpty():
        return found
    # written, so that a number is the same whenever it is read
    numbered = lost.withColumn("doc_id", F.lit((1 << 63) - 1) - F.monotonically_increasing_id())
    return found.union(materialise(numbered.withColumn("nameless", F.lit(True)), "nameless"))


def _kept(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of :func:`_named` whose doc_id is among ``ids``, without the numbers it gave."""
    kept = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; ``und`` goes."""
    found = langid_rank.tagged(docs.select(*COLUMNS), langid_rank.learn_folds(docs))
    return found.where(F.col("lang_pred") != langid_rank.UNKNOWN).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows = _named(docs)
    return _kept(rows, exact_mph.exact_groups(rows).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that links connect.

    Shingles of five words and a similarity of 0.8.
    """
    rows = _named(docs)
    return _kept(rows, sigtree_join.shingle_components(rows, n=5, threshold=80).where("doc_id = component_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the text."""
    found = pii_bootstrap.find(docs, keep=["text", "lang", "source", "n_chars"])
    spans = pii_bootstrap.all_spans()
    text = F.when(F.size(spans) > 0, pii_bootstrap.redacted(F.col("text"), spans)).otherwise(F.col("text"))
    n_chars = F.when(F.size(spans) > 0, F.length("text_new").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text_new", text).select(
        "doc_id", F.col("text_new").alias("text"), "lang", "source", n_chars.alias("n_chars")
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: one row a piece."""
    return packing_cg.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("pii", private),
    ("packing", packed),
]

#: The stages of models and tokenizers have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
