"""Quality rules as a ledger of bits, in SQL functions alone.

Each rule is evaluated once a document; the ledger keeps its measurements and one bit a
failed rule.  A policy is a mask of rules with a version: applying one, comparing versions
and asking what each rule removes alone are bitwise operations on the ledger, without
another look at a text.

Null text has no words and fails the rule of too few words, like empty text.  Repeated rows
get a row each.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaakya.llm.sqlarrays import WHITE, let, total, words

WINDOW = 8

#: Rule of each bit, over the measurements.  The first two are the base rules.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3"),
    ("word_length", "word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words"),
    ("stutter", "5 * n_stutter > n_words"),
    ("capitals", "2 * n_upper > n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: version -> mask; a version is never changed once ledgers were judged by it.
POLICIES: dict[str, int] = {
    "base": BASE_MASK,
    "v1": (1 << len(RULES)) - 1,
}
CURRENT = "v1"


def _repeat_words(tokens: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))

    def covered(first: Column) -> Column:
        step = lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("long").alias("n"), (p + WINDOW).alias("end")
        )
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.array_sort(first), zero, step, lambda a: a["n"])

    def exact(s: Column) -> Column:
        twin = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        at = F.transform(s, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"]))
        return covered(F.array_compact(at))

    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i, WINDOW), " ").alias("w"), i.alias("i")))
    # equal windows have equal hashes: without a repeated hash no window repeats
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).when(repeats, let(F.array_sort(windows), exact)).otherwise(
        F.lit(0).cast("long")
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row."""
    t, w = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("_words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    count = lambda pattern: (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")
    stutter = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: (a == b).cast("long"))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("_text"), words(t).alias("_words"), lines.alias("_lines"))
    return table.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        total(stutter).alias("n_stutter"),
        count(r"\p{Lu}+").alias("n_upper"),
        count(r"\p{L}+").alias("n_letters"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, one bit a rule."""
    bits = " | ".join(f"IF({rule}, {1 << k}, 0)" for k, (_, rule) in enumerate(RULES))
    return measure(docs).withColumn("failed", F.expr(bits))


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy."""
    base = F.col("failed").bitwiseAND(BASE_MASK) != 0
    passed = F.col("failed").bitwiseAND(POLICIES[version]) == 0
    return book.withColumns({"base_failed": base, "kept": ~base & passed})


def ablations(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule: documents removed, by that rule among others, and by it alone.

    The ledger is counted by its bits first (at most 2 ** len(RULES) rows), and every
    question is answered from those counts.
    """
    policies = POLICIES if policies is None else policies
    asked = [(v, mask, name, BIT[name]) for v, mask in policies.items() for name, _ in RULES if mask & BIT[name]]
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("version"), F.lit(m).alias("mask"), F.lit(n).alias("rule"), F.lit(b).alias("bit"))
            for v, m, n, b in asked
        ]
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    per = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).alias
    return (
        book.groupBy("failed")
        .agg(F.count("*").alias("n"))
        .select("failed", "n", F.inline(rows))
        .groupBy("version", "rule")
        .agg(
            per(hit != 0)("removed"),
            per(hit.bitwiseAND(F.col("bit")) != 0)("failed_rule"),
            per(hit == F.col("bit"))("removed_by_rule_alone"),
        )
    )


def judged(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row a document: measurements, bits and verdict."""
    return apply_policy(ledger(docs), version)
