"""Devanagari words: what they are made of and whether their marks can stand where they do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaakya.functions import fixed
from vaakya.functions.text import nfc


def is_pure(word: Column) -> Column:
    """Whether all characters are Devanagari letters, marks or digits, or white space."""
    return nfc(word).rlike(f"^[{fixed.SCRIPT}{fixed.SPACE}]*$")


#: (rule, what comes before the place, what stands there and after it); the order is that of
#: the checks at one place.  Only the leftmost place counts, then the earliest rule.
_RULES = (
    ("consecutive_matras", "", f"[{fixed.MATRA}][{fixed.MATRA}]"),
    ("initial_matra", "^", f"[{fixed.MATRA}]"),
    ("initial_virama", "^", fixed.VIRAMA),
    ("virama_without_consonant", f"(?<=[^{fixed.CONSONANT}{fixed.NUKTA}])", fixed.VIRAMA),
    ("initial_nukta", "^", fixed.NUKTA),
    ("nukta_without_consonant", f"(?<=[^{fixed.CONSONANT}])", fixed.NUKTA),
)


def first_fault(word: Column) -> Column:
    """struct<position, rule> of the first mark that cannot stand where it does, or null.

    Positions are code points from 0.  An empty word has the rule ``empty`` at 0.
    """
    text = nfc(word)
    places = [
        F.when(
            text.rlike(before + mark),
            F.struct((F.regexp_instr(text, F.lit(before + mark)) - 1).alias("position"), F.lit(k).alias("order"), F.lit(rule).alias("rule")),
        )
        for k, (rule, before, mark) in enumerate(_RULES)
    ]
    worst = F.array_min(F.array_compact(F.array(*places)))
    empty = F.struct(F.lit(0).alias("position"), F.lit("empty").alias("rule"))
    fault = F.struct(worst["position"].alias("position"), worst["rule"].alias("rule"))
    return F.when(text == "", empty).when(worst.isNotNull(), fault)


def fault_reason(word: Column) -> Column:
    """``first_fault`` in words; ``Valid Devanagari sequence`` for a word without fault."""
    text, fault = nfc(word), first_fault(word)
    at = fault["position"]
    char = lambda k: F.substring(text, at + 1 + k, F.lit(1))
    place = at.cast("string")
    said = {
        "empty": F.lit("Empty word"),
        "consecutive_matras": F.concat(F.lit("Consecutive matras at position "), place, F.lit(": '"), char(0), F.lit("' + '"), char(1), F.lit("'")),
        "initial_matra": F.concat(F.lit("Word starts with matra '"), char(0), F.lit("'")),
        "initial_virama": F.lit("Word starts with virama"),
        "virama_without_consonant": F.concat(
            F.lit("Virama at position "), place, F.lit(" doesn't follow consonant (preceded by '"), char(-1), F.lit("')")
        ),
        "initial_nukta": F.lit("Word starts with nukta"),
        "nukta_without_consonant": F.concat(F.lit("Nukta at position "), place, F.lit(" doesn't follow consonant")),
    }
    out = F.when(fault.isNull(), F.lit("Valid Devanagari sequence"))
    for rule, text_of in said.items():
        out = out.when(fault["rule"] == rule, text_of)
    return out


def character_breakdown(word: Column) -> Column:
    """struct of how many characters of each kind a word has."""
    text = nfc(F.coalesce(word, F.lit("")))
    kinds = {
        "consonants": fixed.CONSONANT,
        "vowels": fixed.VOWEL,
        "matras": fixed.MATRA,
        "virama": fixed.VIRAMA,
        "anusvara": fixed.ANUSVARA,
        "visarga": fixed.VISARGA,
        "nukta": fixed.NUKTA,
    }
    count = lambda body: F.length(F.regexp_replace(text, body, ""))
    columns = [count(f"[^{body}]").alias(kind) for kind, body in kinds.items()]
    return F.struct(*columns, count(f"[{''.join(kinds.values())}]").alias("other"))
