"""Spelling as a cascade: each stage decides words and only the rest go on to dearer stages.

Order: dictionary, transliteration, suffix of a known root, order of marks, one edit from a
known word, frequency, two edits.  Edit distance is found by equal keys, not by comparing all
words: two words within d edits share a form that is left when up to d characters are deleted
from each, so both sides are exploded to such forms, joined on them, and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaakya.functions import devanagari, fixed
from vaakya.functions.text import nfc, strip


def core_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in fixed.core_words()], "word string").select(nfc(F.col("word")).alias("word"))


def transliterations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.TRANSLITERATIONS.items()), "word string, english string").select(
        nfc(F.col("word")).alias("word"), "english"
    )


def normalised(word: Column) -> Column:
    return nfc(strip(F.coalesce(word, F.lit(""))))


def frequencies(words: DataFrame) -> DataFrame:
    """``word, n`` of all words that are not blank."""
    return words.select(normalised(F.col("word")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def ordered_distinct(words: DataFrame) -> DataFrame:
    """``word, ord``: each normal form once, at its first place."""
    return words.select(nfc(strip(F.col("word"))).alias("word"), "ord").groupBy("word").agg(F.min("ord").alias("ord"))


def _without_one(word: Column) -> Column:
    n = F.length(word)
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    ).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, distance: int) -> Column:
    """The word and what is left of it without up to ``distance`` characters."""
    forms = layer = F.array(word)
    for _ in range(distance):
        layer = F.array_distinct(F.flatten(F.transform(layer, _without_one)))
        forms = F.concat(forms, layer)
    return F.array_distinct(forms)


def near_words(words: DataFrame, lexicon: DataFrame, distance: int) -> DataFrame:
    """``word, candidate, distance`` for every known word within ``distance`` edits."""
    left = words.select("word").distinct().withColumn("form", F.explode(deletions(F.col("word"), distance)))
    right = lexicon.select(F.col("word").alias("candidate")).distinct().withColumn("form", F.explode(deletions(F.col("candidate"), distance)))
    pairs = left.join(right, "form").select("word", "candidate").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "candidate", distance)).where("distance >= 0")


def candidates(words: DataFrame, lexicon: DataFrame, distance: int = 2, most: int = 5) -> DataFrame:
    """The ``most`` nearest known words of each word, by distance and then by code points."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))
    return near_words(words, lexicon, distance).withColumn("rank", rank).where(F.col("rank") <= most)


def nearest(words: DataFrame, lexicon: DataFrame, distance: int) -> DataFrame:
    """``word, candidate, distance``: the nearest known word of each word that has one."""
    best = F.min(F.struct("distance", "candidate")).alias("best")
    return near_words(words, lexicon, distance).groupBy("word").agg(best).select("word", "best.candidate", "best.distance")


def inflections(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, root, suffix``: the longest suffix that leaves a known root of two characters or more."""
    lengths = sorted({len(s) for s in fixed.SUFFIXES})
    n = F.length("word")
    cuts = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: n - k >= 2)
    parts = (
        words.select("word", F.explode(cuts).alias("k"))
        .select("word", F.expr("left(word, length(word) - k)").alias("root"), F.expr("right(word, k)").alias("suffix"))
        .where(F.col("suffix").isin(list(dict.fromkeys(fixed.SUFFIXES))))
    )
    known = parts.join(lexicon.select(F.col("word").alias("root")), "root", "left_semi")
    return known.groupBy("word").agg(F.max_by(F.struct("root", "suffix"), F.length("suffix")).alias("best")).select("word", "best.*")


def classify_distinct(words: DataFrame, lexicon: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One verdict for each row of ``words(word)``, whose words are normal forms and distinct.

    ``counts(word, n)`` turns the frequency stage on.  Each stage looks only at the words that
    no earlier one decided, and its finding is joined back to the list.
    """
    lexicon = lexicon.select(nfc(F.col("word")).alias("word")).distinct()
    known = lexicon.withColumn("known", F.lit(True))
    looked = words.select("word").join(known, "word", "left").join(F.broadcast(transliterations(words.sparkSession)), "word", "left")
    undecided = "known is null and english is null and word != ''"
    inflected = looked.join(inflections(looked.where(undecided), lexicon), "word", "left")
    judged = inflected.withColumn("fault", F.when(devanagari.is_pure(F.col("word")), devanagari.first_fault(F.col("word"))))
    undecided += " and root is null and fault is null"
    # one search to distance two serves both stages: a word at distance one is nearer
    near = judged.join(nearest(judged.where(undecided), lexicon, 2), "word", "left")
    if counts is None:
        near = near.withColumn("n", F.lit(None).cast("long"))
    else:
        near = near.join(counts.select("word", "n"), "word", "left")

    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    c = F.col
    stages = (
        (c("word") == "", "incorrect", F.lit("Empty word"), 0),
        (c("known").isNotNull(), "correct", F.lit("Found in dictionary"), 1),
        (c("english").isNotNull(), "correct", text("English transliteration: ", c("english")), 1),
        (c("root").isNotNull(), "correct", text("Morphological: Root '", c("root"), "' + suffix '", c("suffix"), "'"), 2),
        (c("fault").isNotNull(), "incorrect", text("Invalid Unicode: ", devanagari.fault_reason(c("word"))), 3),
        (c("distance") == 1, "incorrect", text("Likely typo (edit distance 1 from '", c("candidate"), "')"), 4),
        (c("n") >= fixed.FREQUENT, "correct", text("High frequency (", c("n"), " occurrences) — likely valid"), 4),
        (c("distance") == 2, "uncertain", text("Near '", c("candidate"), "' (edit distance 2)"), 5),
        (F.lit(True), "uncertain", F.lit("Not in dictionary, unknown word"), 5),
    )
    verdict = F.lit(None)
    for holds, label, reason, layer in reversed(stages):
        made = F.struct(F.lit(label).alias("classification"), reason.alias("reason"), F.lit(layer).alias("layer"))
        verdict = F.when(holds, made).otherwise(verdict)
    suggested = (c("v.classification") != "correct") & (c("v.layer") >= 4)
    return near.withColumn("v", verdict).select(
        "word", "v.*", F.when(suggested, F.coalesce("candidate", F.lit(""))).otherwise(F.lit("")).alias("suggestion")
    )


def classify(words: DataFrame, lexicon: DataFrame, with_frequency: bool = True) -> DataFrame:
    """A verdict for every row of ``words(word, ...)``: repeated words are decided once.

    Other columns stay.  ``classification`` is the delivered label (an uncertain word counts
    as incorrect), ``detailed_classification`` the cascade's own.
    """
    rows = words.withColumn("_norm", normalised(F.col("word")))
    distinct = rows.select(F.col("_norm").alias("word")).distinct()
    verdicts = classify_distinct(distinct, lexicon, frequencies(words) if with_frequency else None)
    label = F.when(F.col("detailed_classification") == "correct", F.lit("correct_spelling")).otherwise(F.lit("incorrect_spelling"))
    return (
        rows.join(verdicts.withColumnsRenamed({"word": "_norm", "classification": "detailed_classification"}), "_norm")
        .withColumn("classification", label)
        .drop("_norm")
    )


def by_label(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(F.count("*").alias("n"))


def by_layer(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.concat(F.lit("layer_"), F.col("layer").cast("string")).alias("layer")).agg(F.count("*").alias("n"))
