"""Message text: cleaning, words, stop words and selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V


def clean_text(text: Column) -> Column:
    """Letters and white space only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z\s]+", ""))


def message_words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, r"\W"), lambda word: word != "")


def without_stop_words(words: Column) -> Column:
    """Stop words out, repeated words kept."""
    return F.filter(words, lambda word: ~word.isin(*V.STOP_WORDS))


def mentions(text: Column, keywords: tuple[str, ...]) -> Column:
    """True when any keyword stands in the text as a whole word, in any case."""
    any_word = "|".join(rf"\Q{word.lower()}\E" for word in keywords)
    return F.lower(text).rlike(rf"(^|[^a-z0-9_])({any_word})([^a-z0-9_]|$)")


def on_one_line(text: Column) -> Column:
    """``text`` with backslashes doubled and line breaks written as backslash sequences, for a line of a file."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def off_one_line(text: Column) -> Column:
    """The text that ``on_one_line`` was given."""
    parts = F.split(text, r"\\\\")  # at doubled backslashes; what is left are single ones
    broken = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    )
    return F.array_join(broken, "\\")
