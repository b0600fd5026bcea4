"""Text expressions. All are native column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from casebook.functions.words import STOP_WORDS

# The cleaning patterns. (?U) gives \d \s \S their Unicode meaning.
URL = r"(?U)http\S+"
DIGITS = r"(?U)\d+"
URL_OR_DIGITS = r"(?U)http\S+|\d+"
REDACTION = r"\bx{2,}\b"
NOT_LETTER_OR_SPACE = r"(?U)[^a-z\s]"
SPACES = r"(?U)\s+"
NOT_LETTERS = r"[^a-z]+"
NON_ASCII = r"[^\x00-\x7F]"
MAX_PARAPHRASE_CHARS = 5000


def words(text: Column) -> Column:
    """Whitespace tokens; blank text has none."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def unique_word_count(text: Column) -> Column:
    return F.size(F.array_distinct(words(text)))


def lower_case(text: Column) -> Column:
    return F.lower(text)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_redaction(text: Column, mode: str = "keep") -> Column:
    """Redaction marks such as ``xxxx`` in lower-cased text.

    ``keep`` leaves them as tokens (the default behaviour to match); ``strip`` removes them.
    """
    if mode == "keep":
        return text
    if mode == "strip":
        return F.regexp_replace(text, REDACTION, "")
    raise ValueError(f"unknown redaction mode: {mode}")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, "")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, NOT_LETTER_OR_SPACE, " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalised(text: Column, redaction: str = "keep") -> Column:
    """Lower case, no URLs, no digits, letters only, single blanks."""
    text = strip_redaction(strip_urls(lower_case(text)), redaction)
    return squeeze(letters_only(strip_digits(text)))


def without_short(tokens: Column, shortest: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.char_length(t) >= shortest)


def without_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Drop stop words; repeats of other tokens stay."""
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def clean_tokens(
    text: Column, redaction: str = "keep", stop_words: Sequence[str] = STOP_WORDS
) -> Column:
    """The token list of :func:`normalised` text without short tokens and stop words.

    Same result as the single steps in a row, in two regular-expression passes: URLs and
    digits go in one replacement, and splitting on everything that is no letter does the
    work of the letter filter, the blank squeeze and the tokeniser together.
    """
    if redaction == "keep":
        text = F.regexp_replace(F.lower(text), URL_OR_DIGITS, "")
    else:
        text = strip_digits(strip_redaction(strip_urls(F.lower(text)), redaction))
    wanted = list(stop_words)
    return F.filter(
        F.split(text, NOT_LETTERS), lambda t: (F.char_length(t) > 1) & ~t.isin(wanted)
    )


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def has_non_ascii(text: Column) -> Column:
    return text.rlike(NON_ASCII)


def within_length(text: Column, limit: int = MAX_PARAPHRASE_CHARS) -> Column:
    """Texts above the limit are skipped as a whole, never cut."""
    return F.char_length(text) <= limit
