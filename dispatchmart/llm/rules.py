"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged on its own: by its punctuation, as navigation, as boilerplate. Failed lines are
removed; a document that loses too large a part of its text this way is rejected. A few whole-text
measures reject very short and very repetitive texts beforehand. There is no shuffle: a text never leaves its row.

Defined results: a null or empty text has no words and no lines and is rejected as too short; equal texts get equal
verdicts, each row of them is kept; an empty table gives an empty one. ``measure`` reads the identifier and the text
only; ``judged`` keeps every column and adds one struct under a name the caller chooses.

Repeated windows are found by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import WORD_GAPS, id_and_text

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_SHARE = 0.5
NAVIGATION_SEPARATORS = 3
NAVIGATION_WORDS_EACH = 6
BOILERPLATE_MAX_WORDS = 25

# Characters that count as symbols, as given.
SYMBOLS = "[#*$%&|<>]"

# Phrases of short lines that say nothing about the subject of a page.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "share this",
    "skip to content",
    "back to top",
)

_SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*([\\s]|$)"
_SHOUTED = "[!?]{2,}"
_SEPARATORS = "[|»›•·>]"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAPS))


def line_fault(line: Column) -> Column:
    """Why ``line`` fails: ``punctuation``, ``navigation`` or ``boilerplate``; null when it passes.

    * punctuation: no sentence ends in it, or doubled marks end more than a third of its words;
    * navigation: at least three separators, and no more than six words to each;
    * boilerplate: a short line with a listed phrase.

    A line without a word passes: it loses nothing.
    """
    gaps = F.regexp_count(F.btrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(WORD_GAPS))
    words = gaps + 1
    separators = F.regexp_count(line, F.lit(_SEPARATORS))
    phrases = "(?i)" + "|".join(BOILERPLATE)
    return (
        F.when(~line.rlike("[^\\x20\\x09-\\x0D]"), F.lit(None).cast("string"))
        .when(~line.rlike(_SENTENCE_END) | (3 * F.regexp_count(line, F.lit(_SHOUTED)) > words), F.lit("punctuation"))
        .when(
            (separators >= NAVIGATION_SEPARATORS) & (words <= NAVIGATION_WORDS_EACH * separators), F.lit("navigation")
        )
        .when((words <= BOILERPLATE_MAX_WORDS) & line.rlike(phrases), F.lit("boilerplate"))
    )


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in windows of three that ``_words`` holds twice or more.

    Windows are hashed. Only a text with a repeated hash is looked at further: its windows are sorted with
    their places, and places whose neighbour has the same hash are kept. Places in order then
    add three words each, less what the window before has covered.
    """
    n = F.size("_words")
    df = df.withColumn("_second", F.slice("_words", F.lit(2), F.greatest(n - 1, F.lit(0))))
    df = df.withColumn("_third", F.slice("_words", F.lit(3), F.greatest(n - 2, F.lit(0))))
    pairs = F.zip_with("_words", "_second", lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, "_third", lambda p, c: F.xxhash64(p, c)), F.lit(1), F.greatest(n - 2, F.lit(0)))
    df = df.withColumn("_windows", windows).drop("_second", "_third")
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda hash_, i: F.struct(hash_.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(placed)).otherwise(none)).drop("_windows")
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("_sorted"))
    df = df.withColumn("_before", before)
    df = df.withColumn("_after", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))))
    marked = F.zip_with(
        F.zip_with("_sorted", "_before", lambda x, b: F.struct(x.alias("x"), (x["h"] == b["h"]).alias("like"))),
        "_after",
        lambda m, a: F.when(m["like"] | (m["x"]["h"] == a["h"]), m["x"]["i"]),
    )
    df = df.withColumn("_places", F.sort_array(F.filter(marked, lambda place: place.isNotNull())))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_places",
        state,
        lambda s, at: F.struct(
            (at + 3).alias("end"), (s["n"] + F.least(F.lit(3), at + 3 - s["end"])).cast("int").alias("n")
        ),
        lambda s: s["n"].cast("long"),
    )
    return df.withColumn("n_repeat_words", covered).drop("_sorted", "_before", "_after", "_places")


def _has_fault(name: str) -> Callable[[Column], Column]:
    return lambda judged: judged["fault"] == name


def _measured(df: DataFrame, max_lost: float) -> DataFrame:
    """Add the measures of ``text``, the lines that pass and the verdict."""
    df = df.withColumn("_words", _words(F.col("text"))).withColumn("_lines", F.split("text", "\n"))
    df = _repeated_words(df)
    judged = F.transform("_lines", lambda line: F.struct(line.alias("line"), line_fault(line).alias("fault")))
    df = df.withColumn("_judged", judged)
    df = df.withColumn("_full", F.filter("_lines", lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    passed = F.transform(F.filter("_judged", lambda j: j["fault"].isNull()), lambda j: j["line"])
    df = df.withColumn("clean_text", F.array_join(passed, "\n"))
    df = df.select(
        *[c for c in df.columns if c not in ("_words", "_lines", "_judged", "_full")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        *[
            F.size(F.filter("_judged", _has_fault(name))).cast("long").alias(f"n_{name}_lines")
            for name in ("punctuation", "navigation", "boilerplate")
        ],
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    # Line feeds are no loss: they are counted on neither side.
    size = F.length("text") - F.regexp_count("text", F.lit("\n"))
    kept = F.length("clean_text") - F.regexp_count("clean_text", F.lit("\n"))
    df = df.withColumn("base_failed", base)
    df = df.withColumn("lost_share", F.when(size > 0, (size - kept) / size).otherwise(F.lit(0.0)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))


def measure(
    docs: DataFrame, max_lost: float = MAX_LOST_SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, all measures, counts of failed lines per rule, ``clean_text``, ``lost_share`` and ``kept``."""
    return _measured(id_and_text(docs, id_col, text_col), max_lost).drop("text")


def clean(docs: DataFrame, max_lost: float = MAX_LOST_SHARE, text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, failed lines removed from ``text_col``."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    # A filter would be pushed down to the text, with all measures written into it over and over; it stays
    # above a column that is not a function of the row.
    measured = _measured(whole, max_lost).withColumn("_at", F.monotonically_increasing_id())
    kept = measured.where(F.col("kept") & (F.col("_at") >= 0))
    return kept.select(*[F.col("clean_text" if c == text_col else f"_row.`{c}`").alias(c) for c in docs.columns])
