"""Position lattices over several systems' outputs, votes, and the corrected reference.

All outputs of an utterance stand in its row, so alignment, lattice, votes and correction are
one projection of that row: nothing is shuffled until results are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaakya.functions import fixed
from vaakya.functions.arrays import let
from vaakya.functions.text import normalize_for_wer, percent, tokens
from vaakya.operators.align import EPSILON, NAMES, align, align_each, metrics, pairs

MODELS = "array<struct<model_idx:int,name:string,hyp:string>>"


def aligned(utterances: DataFrame) -> DataFrame:
    """``utterances(utt_id, reference, models)`` with normalised words and each system's operations.

    ``models`` is an array in the systems' order; it gets ``words`` and ``ops``.
    """
    base = utterances.select(
        "utt_id",
        normalize_for_wer(F.col("reference")).alias("reference"),
        F.transform(
            "models", lambda m: F.struct(m["model_idx"], m["name"], tokens(normalize_for_wer(m["hyp"])).alias("words"))
        ).alias("models"),
    ).withColumn("ref_words", tokens(F.col("reference")))
    ops = base.withColumn("_ops", align_each(F.col("ref_words"), F.col("models.words")))
    merged = F.zip_with(
        "models", "_ops", lambda m, o: F.struct(m["model_idx"], m["name"], m["words"], o.alias("ops"))
    )
    return ops.withColumn("models", merged).drop("_ops")


def cells(lines: DataFrame) -> DataFrame:
    """The lattice as rows: utt_id, ref_pos, is_insertion, model_idx, nth, ref_word, word, op.

    Insertions stand before ``ref_pos`` and are numbered; all are kept.
    """
    each = lines.select("utt_id", "ref_words", F.explode("models").alias("m")).select(
        "utt_id", F.col("m.model_idx").alias("model_idx"), pairs(F.col("ref_words"), F.col("m.words"), F.col("m.ops")).alias("p")
    )
    # an operation's number among those at its place: the last one that is no insertion came to the place
    solid = lambda p: F.filter(F.transform(p, lambda c, k: F.when(c["op"] != NAMES["I"], k)), lambda k: k.isNotNull())
    numbered = let(
        F.struct(F.col("p").alias("p"), solid(F.col("p")).alias("s")),
        lambda x: F.transform(
            x["p"],
            lambda c, k: F.struct(
                c["ref_at"],
                (k - 1 - F.coalesce(F.get(x["s"], c["ref_at"] - 1), F.lit(-1))).alias("nth"),
                c["ref"],
                c["hyp"],
                c["op"],
            ),
        ),
    )
    return each.select("utt_id", "model_idx", F.explode(numbered).alias("c")).select(
        "utt_id",
        (F.col("c.ref_at") - (F.col("c.op") != NAMES["I"]).cast("int")).alias("ref_pos"),
        (F.col("c.op") == NAMES["I"]).alias("is_insertion"),
        "model_idx",
        F.when(F.col("c.op") == NAMES["I"], F.col("c.nth")).alias("nth"),
        F.col("c.ref").alias("ref_word"),
        F.col("c.hyp").alias("word"),
        F.col("c.op").alias("op"),
    )


def position_lattice(lines: DataFrame) -> DataFrame:
    """One row a reference position, and one an insertion key ``{ref_pos}_ins_{model_idx}``.

    Of several insertions of one system at one place the last counts; other systems have
    ``<eps>`` and no operation there.
    """
    whole = cells(lines)
    n = lines.select("utt_id", F.size("models").alias("n"), F.col("models.model_idx").alias("order"))
    keyed = whole.withColumn(
        "key", F.when(F.col("is_insertion"), F.concat_ws("_ins_", "ref_pos", "model_idx")).otherwise(F.col("ref_pos").cast("string"))
    )
    # of one system's cells under a key only the last insertion is left
    last = keyed.groupBy("utt_id", "key", "ref_pos", "is_insertion", "model_idx").agg(
        F.max_by(F.struct("ref_word", "word", "op"), F.coalesce("nth", F.lit(0))).alias("c")
    )
    # one cell a system: a row's array is as long as the number of systems
    grouped = last.groupBy("utt_id", "key", "ref_pos", "is_insertion").agg(
        F.max("c.ref_word").alias("ref_word"), F.map_from_entries(F.collect_list(F.struct("model_idx", "c"))).alias("by_model")
    )
    at = lambda i, f: F.element_at(F.col("by_model"), i)[f]
    return grouped.join(n, "utt_id").select(
        "utt_id",
        "key",
        "ref_pos",
        "is_insertion",
        "ref_word",
        F.transform("order", lambda i: F.coalesce(at(i, "word"), F.lit(EPSILON))).alias("model_words"),
        F.transform("order", lambda i: at(i, "op")).alias("operations"),
    )


def consensus(words: Column, threshold: int = fixed.CONSENSUS) -> Column:
    """struct<word, votes, reason>: the word most systems have, if enough do.

    Systems without a word don't vote; of words with equal votes the one of the earlier system
    wins; ``votes`` is the highest count whether or not it is enough.
    """
    voting = F.filter(words, lambda w: w != EPSILON)
    total = F.size(words).cast("string")

    def decide(v: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(v), lambda w, k: F.struct(F.size(F.filter(v, lambda x: x == w)).alias("n"), (-k).alias("order"), w.alias("w"))
        )
        best = F.array_max(ranked)
        n, share = F.coalesce(best["n"], F.lit(0)), F.concat(best["n"].cast("string"), F.lit("/"), total)
        enough = n >= threshold
        reason = (
            F.when(F.size(v) == 0, F.lit("All models have insertions/deletions at this position"))
            .when(enough, F.concat(F.lit("Consensus: "), share, F.lit(" models agree on '"), best["w"], F.lit("'")))
            .otherwise(F.concat(F.lit("No consensus: highest agreement is "), share, F.lit(f" (threshold={threshold})")))
        )
        return F.struct(F.when(enough & (F.size(v) > 0), best["w"]).alias("word"), n.alias("votes"), reason.alias("reason"))

    return let(voting, decide)


def voted(lines: DataFrame, threshold: int = fixed.CONSENSUS) -> DataFrame:
    """``lines`` with ``votes``, an array of one struct a reference position, and ``corrected`` words."""
    columns = F.transform("models", lambda m: F.filter(pairs(F.col("ref_words"), m["words"], m["ops"]), lambda p: p["op"] != NAMES["I"])["hyp"])
    base = lines.withColumn("_by_model", columns)

    def at(word: Column, k: Column) -> Column:
        words = F.transform("_by_model", lambda row: F.get(row, k))
        return let(
            words,
            lambda w: let(
                consensus(w, threshold),
                lambda c: F.struct(
                    k.alias("position"),
                    word.alias("original_ref"),
                    F.coalesce(c["word"], word).alias("corrected_to"),
                    (c["word"].isNotNull() & (c["word"] != word)).alias("changed"),
                    F.concat(c["votes"].cast("string"), F.lit("/"), F.size(w).cast("string")).alias("agreement"),
                    c["reason"].alias("reason"),
                    w.alias("model_outputs"),
                ),
            ),
        )

    votes = base.withColumn("votes", F.transform("ref_words", at)).drop("_by_model")
    return votes.withColumn("corrected", F.col("votes.corrected_to"))


def corrections(lines: DataFrame) -> DataFrame:
    """One row a replaced reference word, from :func:`voted`."""
    rows = lines.select("utt_id", F.inline(F.filter("votes", lambda v: v["changed"])))
    return rows.drop("changed")


def correction_analysis(found: DataFrame) -> DataFrame:
    """Corrections counted by agreement."""
    return found.groupBy("agreement").agg(F.count("*").alias("n"))


def correction_summary(found: DataFrame, examples: int = 10) -> DataFrame:
    """One row: how many corrections, by agreement, and the first ones; ``correction_rate`` is ``0%`` without any."""
    counts = correction_analysis(found)
    # as many levels as systems, and a few examples
    levels = counts.agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("agreement", "n")))).alias("agreement_distribution"))
    first = found.orderBy("utt_id", "position").limit(examples)
    shown = first.agg(F.array_sort(F.collect_list(F.struct("utt_id", "position", "original_ref", "corrected_to", "agreement", "reason"))).alias("examples"))
    total = F.coalesce("n", F.lit(0))
    return levels.join(F.broadcast(shown), F.lit(True)).select(
        total.alias("total_corrections"),
        F.when(total == 0, F.lit("0%")).alias("correction_rate"),
        "agreement_distribution",
        "examples",
    )


def scores(lines: DataFrame) -> DataFrame:
    """One row a system and utterance: error rates against the reference and the corrected one.

    ``wer`` is a number; ``wer_pct`` beside it is its text.
    """
    # exploded first: the corrected words are then a column of their own for the second alignment
    rows = lines.select("utt_id", "reference", "corrected", F.explode("models").alias("m"))
    each = rows.select(
        "utt_id",
        "reference",
        F.array_join("corrected", " ").alias("corrected_reference"),
        "m.model_idx",
        "m.name",
        "m.ops",
        align(F.col("corrected"), F.col("m.words")).alias("lattice_ops"),
    )
    standard, lattice = metrics(F.col("ops")), metrics(F.col("lattice_ops"))
    return each.select(
        "utt_id",
        "reference",
        "corrected_reference",
        "model_idx",
        "name",
        standard.alias("standard"),
        lattice.alias("lattice"),
        percent(standard["wer"]).alias("standard_wer_pct"),
        percent(lattice["wer"]).alias("lattice_wer_pct"),
        (lattice["wer"] - standard["wer"]).alias("delta"),
    )
