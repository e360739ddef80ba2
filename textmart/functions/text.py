"""Text and label expressions. Everything here stays in the JVM and needs no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed

Rules = Sequence[tuple[str, str]]

# Whitespace that \s in a pattern does not match.
SPACES = " \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def apply_rules(text: Column, rules: Rules) -> Column:
    """Replace each (pattern, replacement) in order."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def squeeze(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.trim(text), r"\s+", " "))


def normalize_whitespace(text: Column) -> Column:
    """Tabs and line breaks, real or spelt out as two characters, become a space."""
    return F.regexp_replace(text, r"\\[tnr]|[\t\n\r]", " ")


def clean_text(text: Column, drop: str = fixed.CLEAN_REPORT, rules: Rules = fixed.ARTICLE_RULES,
               tidy: bool = False) -> Column:
    """Characters in `drop` become spaces, then `rules` apply; `tidy` also squeezes the spaces."""
    cleaned = apply_rules(F.regexp_replace(text, drop, " "), rules)
    return F.trim(F.regexp_replace(cleaned, r"\s+", " ")) if tidy else cleaned


def normalize_label(label: Column, rules: Rules = fixed.GROUP_RULES) -> Column:
    return apply_rules(label, rules)


def comparison_key(name: Column, rules: Rules = fixed.NAME_KEY_RULES) -> Column:
    """A key that is equal for names that differ in word order, spacing or the spellings in `rules`."""
    words = F.sort_array(F.split(apply_rules(squeeze(name), rules), " "))
    return squeeze(F.array_join(words, " "))


def split_multi(cell: Column, delimiters: str = fixed.MEMBER_DELIMITERS, trim: bool = True,
                drop_empty: bool = False) -> Column:
    """The values listed in one cell, as an array."""
    parts = F.split(cell, delimiters)
    if trim:
        parts = F.transform(parts, lambda part: F.trim(part))
    if drop_empty:
        parts = F.filter(parts, lambda part: part != "")
    return parts


def tokenize_regex(text: Column, gaps: str = fixed.TOKEN_GAPS) -> Column:
    """Lower-case words between matches of `gaps`; no empty words."""
    return F.filter(F.split(F.lower(text), gaps), lambda word: word != "")


def tokenize_whitespace(text: Column) -> Column:
    """Lower-case words between single whitespace characters.

    Empty words inside or before the text count as words; those after its end do not. The empty
    text is one empty word. Keep only texts that satisfy `has_words`.
    """
    return F.split(F.rtrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"\s")


def has_words(text: Column) -> Column:
    """Whether `tokenize_whitespace` finds a word: not in null, nor in whitespace alone."""
    return (text == "") | text.rlike(r"\S")


def remove_stop_words(words: Column, stop_words: Iterable[str], ignore_case: bool = True) -> Column:
    stops = sorted({w.lower() for w in stop_words} if ignore_case else set(stop_words))
    if not stops:
        return words
    return F.filter(words, lambda w: ~(F.lower(w) if ignore_case else w).isin(stops))


def ngram_prefixes(words: Column, size: int = fixed.NGRAM_SIZE) -> Column:
    """For every full window of `size` words, its prefixes of 1 to `size` words, joined by a space."""
    def prefixes(first: Column, at: Column) -> Column:
        window = [first, *[F.get(words, at + i) for i in range(1, size)]]
        return F.array(first, *[F.concat_ws(" ", *window[:n]) for n in range(2, size + 1)])

    starts = F.slice(words, F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.flatten(F.transform(starts, prefixes)))


SHORT_NAME = 40


def one_edit_variants(text: Column) -> Column:
    """Keys of which two texts share one if they are within one insertion, deletion or substitution of each other.

    A short text's keys are itself and all it becomes by deleting one character. Those of a text of at
    least SHORT_NAME characters are halves: one edit leaves the first or the last half of the shorter
    text alone. As the other text may be one longer, each gives the halves of two lengths. Texts of about
    SHORT_NAME characters have both kinds of keys; no text has more than a few of them per character.
    """
    size = F.length(text)
    shorter = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size)),
    )

    def halves(of: Column) -> list[Column]:
        half = F.floor(of / 2).cast("int")
        told = of.cast("string")
        return [F.concat(F.lit("<"), told, F.lit("|"), F.substring(text, F.lit(1), half)),
                F.concat(F.lit(">"), told, F.lit("|"), F.substring(text, size - half + 1, half))]

    none = F.array().cast("array<string>")
    deleted = F.when(size == 0, F.array(text)).when(size <= SHORT_NAME + 1, F.concat(F.array(text), shorter)).otherwise(none)
    halved = F.when(size >= SHORT_NAME, F.array(*halves(size), *halves(size - 1))).otherwise(none)
    return F.when(text.isNotNull(), F.array_distinct(F.concat(deleted, halved)))
