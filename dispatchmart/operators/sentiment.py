"""Polarity and subjectivity of messages from a lexicon table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions.messages import clean_text
from dispatchmart.operators.joins import BROADCAST_ROWS, fits_broadcast, spread_join
from dispatchmart.session import checkpoint_dir

_KEY = "_message"
SCORES = ["polarity", "subjectivity"]
SCALE = 10**10
"""Scores are added up as whole numbers of this scale: any order of rows gives the same sum."""
IN_ROW_ENTRIES = 50_000
IN_ROW_BYTES = 8 * 1024 * 1024
SLOTS = 1 << 14
"""Slots of the lexicon value; the largest lexicon scored in the row has three entries or so in each."""


def _entries(lexicon: DataFrame) -> DataFrame:
    """One entry per term, with scaled scores; of several the least."""
    scaled = [F.round(F.col(c).cast("double") * SCALE).cast("long").alias(c) for c in SCORES]
    return lexicon.where(F.col("term").isNotNull()).groupBy("term").agg(F.min(F.struct(*scaled)).alias("_entry"))


def fits_in_row(lexicon: DataFrame) -> bool:
    """Whether the lexicon, measured by one aggregate, is small enough to be one value of a plan."""
    return fits_broadcast(lexicon, IN_ROW_ENTRIES, IN_ROW_BYTES)


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def lexicon_value(lexicon: DataFrame) -> Column:
    """The lexicon as one array value: in each slot a map of the few terms that hash to it."""
    entry = F.struct("term", "_entry")
    maps = _entries(lexicon).groupBy(_slot(F.col("term")).alias("_slot")).agg(F.map_from_entries(F.collect_list(entry)).alias("_terms"))
    every = lexicon.sparkSession.range(SLOTS).join(maps, F.col("id") == F.col("_slot"), "left")
    by_slot = F.array_sort(F.collect_list(F.struct("id", "_terms")), lambda a, b: (a["id"] - b["id"]).cast("int"))
    return every.agg(F.transform(by_slot, lambda slot: slot["_terms"])).scalar()


def _mean(total: Column, words: Column) -> Column:
    return total.cast("double") / SCALE / words


def scored_in_row(df: DataFrame, lexicon: DataFrame, text: str = "tweet", cleaned: bool = False) -> DataFrame:
    """``df`` with the mean scores of each message's lexicon words, 0 without any; no row leaves its task.

    Each word looks up its slot of the lexicon value.
    """
    letters = F.col(text) if cleaned else clean_text(F.col(text))
    valued = df.withColumn("_lexicon", lexicon_value(lexicon))
    found = F.transform(F.split(letters, r"\W"), lambda word: F.try_element_at(F.get("_lexicon", _slot(word)), word))
    hits = valued.withColumn("_hits", F.array_compact(found)).drop("_lexicon")

    def mean(score: str) -> Column:
        total = F.aggregate("_hits", F.lit(0).cast("long"), lambda acc, hit: acc + hit[score])
        return F.when(F.size("_hits") > 0, _mean(total, F.size("_hits"))).otherwise(F.lit(0.0)).alias(score)

    return hits.select(*df.columns, *[mean(score) for score in SCORES])


def text_scores(
    df: DataFrame, lexicon: DataFrame, key: str, text: str, cleaned: bool = False, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Mean scores of the lexicon words per ``key``, for a lexicon that is too large for a value; keys without any are absent.

    Words are counted per message before they meet the lexicon.
    """
    letters = F.col(text) if cleaned else clean_text(F.col(text))
    words = df.select(key, F.explode(F.split(letters, r"\W")).alias("term")).where(F.col("term") != "")
    counted = words.groupBy(key, "term").agg(F.count("*").alias("_n"))
    hits = spread_join(counted, _entries(lexicon), ["term"], max_rows=max_rows, bound=lexicon)
    sums = [_mean(F.sum(F.col(f"_entry.{c}") * F.col("_n")), F.sum("_n")).alias(c) for c in SCORES]
    return hits.groupBy(key).agg(*sums)


def add_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "tweet",
    key: str | None = None,
    max_rows: int = BROADCAST_ROWS,
    cleaned: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """``polarity`` and ``subjectivity``, 0 when no word is in the lexicon.

    A lexicon of measured small size is looked up in the row: one scan, no shuffle. ``small`` is the measurement, where the caller
    has made it. A larger one is joined with the words of each message: ``key`` then names a column that is unique per
    message, and without one each message gets a number, which the checkpoint keeps from changing. ``cleaned`` says that
    the text has been through ``clean_text``. Both ways give the same scores.
    """
    if small is None:
        small = max_rows > 0 and fits_in_row(lexicon)
    if small:
        return scored_in_row(df, lexicon, text, cleaned)
    columns = df.columns
    if key is None:
        checkpoint_dir(df.sparkSession)
        key = _KEY
        df = df.checkpoint().withColumn(key, F.monotonically_increasing_id())
    scored = df.join(text_scores(df, lexicon, key, text, cleaned, max_rows), key, "left")
    return scored.select(*columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SCORES])


def message_facts(
    tagged: DataFrame, lexicon: DataFrame, text: str = "tweet", key: str | None = None, small: bool | None = None
) -> DataFrame:
    """Tagged messages, whose text is clean, with their sentiment and without their count vectors."""
    return add_sentiment(tagged.drop("features"), lexicon, text, key, cleaned=True, small=small)
