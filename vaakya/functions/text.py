"""Text functions: Column -> Column, all inside the JVM.

Null text gives what empty text gives, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaakya.functions import fixed


def nfc(text: Column) -> Column:
    """Unicode normalisation form C; null stays null.

    The composer is that of the Unicode library Spark ships; ASCII text, which is in form C
    already, does not reach it.
    """
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{fixed.SPACE}]+", " "))


def clean_text(text: Column) -> Column:
    """Form C, punctuation to spaces, white space collapsed."""
    return collapse(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), f"[{fixed.PUNCTUATION}]", " "))


def normalize_for_wer(text: Column) -> Column:
    """Cleaned, lower-cased, and only letters, numbers, Devanagari and spaces are left."""
    kept = F.regexp_replace(F.lower(clean_text(text)), rf"[^\p{{L}}\p{{N}}{fixed.DEVANAGARI} ]", "")
    return collapse(kept)


def is_devanagari(text: Column, threshold: float = 0.5) -> Column:
    """Whether at least this share of characters other than white space is Devanagari."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{fixed.SPACE}]", "")
    inside = F.length(F.regexp_replace(solid, f"[^{fixed.DEVANAGARI}]", ""))
    return F.when(F.length(solid) > 0, inside / F.length(solid) >= threshold).otherwise(F.lit(False))


def tokens(text: Column) -> Column:
    """Words as Unicode white space separates them; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{fixed.SPACE}]+"), "")


def remove_english_words(text: Column) -> Column:
    """Words that are Devanagari by three tenths at least, joined by spaces."""
    return F.array_join(F.filter(tokens(text), lambda w: is_devanagari(w, 0.3)), " ")


def count_words(text: Column) -> Column:
    return F.size(tokens(text))


def clean_token(token: Column) -> Column:
    """A token as it is compared: lower case, without marks."""
    return F.regexp_replace(F.lower(token), f"[{fixed.TOKEN_MARKS}]", "")


def strip(text: Column) -> Column:
    """White space off both ends; null stays null."""
    return F.regexp_replace(text, f"^[{fixed.SPACE}]+|[{fixed.SPACE}]+$", "")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def transliterate_check(word: Column) -> Column:
    """The English word that a common Devanagari spelling stands for, or null."""
    return F.element_at(_lookup(fixed.COMMON_TRANSLITERATIONS), nfc(strip(word)))


def fixed_point(value: Column, digits: int) -> Column:
    """A number as text with that many digits; halves of its shortest decimal form go to even."""
    return F.bround(value.cast("double").cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def percent(value: Column, digits: int = 2) -> Column:
    return F.concat(fixed_point(value * 100, digits), F.lit("%"))
