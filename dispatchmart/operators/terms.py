"""Terms of messages: counts, the leading ones, and the tag made from them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.messages import clean_text, message_words, without_stop_words
from dispatchmart.operators.joins import BROADCAST_ROWS, spread_join
from dispatchmart.operators.ordered import number_rows
from dispatchmart.session import stored


def add_words(df: DataFrame, text: str = "tweet", words: str = "words_clean") -> DataFrame:
    """The message's words without stop words."""
    return df.withColumn(words, without_stop_words(message_words(clean_text(F.col(text)))))


def _exploded(df: DataFrame, text: str) -> DataFrame:
    """One row per word; empty pieces and stop words go after the explode, inside generated code."""
    term = F.explode(F.split(clean_text(F.col(text)), r"\W")).alias("term")
    rest = [F.col(c) for c in df.columns if c != text]
    return df.select(*rest, term).where(~F.col("term").isin("", *V.STOP_WORDS))


def term_counts(df: DataFrame, text: str = "tweet") -> DataFrame:
    """How often each term occurs in all messages.

    Texts are cut at blanks and line ends only and the pieces are counted as they stand, so that each different piece is
    cleaned once: cleaning drops characters inside pieces and never joins two of them.
    """
    pieces = df.select(F.explode(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), " ")).alias("piece"))
    counted = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    terms = counted.select("n", F.explode(F.split(clean_text(F.col("piece")), r"\W")).alias("term"))
    return terms.where(~F.col("term").isin("", *V.STOP_WORDS)).groupBy("term").agg(F.sum("n").alias("n"))


def document_term_counts(df: DataFrame, key: str, text: str = "tweet") -> DataFrame:
    """How often each term occurs in each message."""
    return _exploded(df.select(key, text), text).groupBy(key, "term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, k: int = V.LISTED_TERMS, text: str = "tweet") -> DataFrame:
    """The ``k`` most frequent terms; equal counts in alphabetical order."""
    return term_counts(df, text).orderBy(F.desc("n"), "term").limit(k)


def top_term_list(df: DataFrame, k: int = V.TAG_TERMS, text: str = "tweet") -> Column:
    """The leading terms as one array value, for use inside another query."""
    return top_terms(df, k, text).agg(F.collect_list("term")).scalar()


def tag(words: Column, leading: Column) -> Column:
    """1 when more than two of the leading terms occur in the message.

    No leading term is a stop word, so ``words`` may still hold stop words.
    """
    return (F.size(F.array_intersect(words, leading)) > V.TAG_THRESHOLD).cast("int")


def add_tag(df: DataFrame, leading: Column | None = None, text: str = "tweet") -> DataFrame:
    """Clean ``text`` and add ``tags`` from the given leading terms, or from those of ``df`` itself."""
    if leading is None:
        leading = top_term_list(df, text=text)
    cleaned = df.withColumn(text, clean_text(F.col(text)))
    return cleaned.withColumn("tags", tag(F.split(F.col(text), r"\W"), leading))


def vocabulary(df: DataFrame, text: str = "tweet", size: int | None = None) -> DataFrame:
    """All terms, or the ``size`` most frequent ones, with their places: 0 for the most frequent one."""
    return _placed(term_counts(df, text), size)


def _placed(counts: DataFrame, size: int | None) -> DataFrame:
    counts = counts.select(F.negative("n").alias("_rank"), "term")
    placed = number_rows(counts, "term_index", ["_rank", "term"], after=-1, rows_differ=True)
    if size is not None:
        placed = placed.where(F.col("term_index") < size)
    return placed.select("term", F.col("term_index").cast("int").alias("term_index"))


def count_vectors(
    df: DataFrame,
    key: str,
    text: str = "tweet",
    size: int | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Sparse count vectors over all terms, or the ``size`` most frequent, as ``indices`` and ``values``.

    The texts are cut into words once: the counts per message are written by column, the vocabulary is
    summed from them and joined back. The vocabulary stays a table; a message without terms has
    empty arrays.
    """
    counts = stored(document_term_counts(df, key, text), "counts")
    terms = _placed(counts.groupBy("term").agg(F.sum("n").alias("n")), size)
    entries = spread_join(counts, terms, ["term"], max_rows=max_rows)
    vectors = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_index", "n"))).alias("_entries"))
    filled = df.select(key).join(vectors, key, "left").withColumn(
        "_entries", F.coalesce("_entries", F.array().cast("array<struct<term_index:int,n:bigint>>"))
    )
    return filled.select(
        key,
        F.col("_entries.term_index").alias("indices"),
        F.col("_entries.n").cast("array<double>").alias("values"),
    )


def add_features(df: DataFrame, size: int, text: str = "tweet") -> DataFrame:
    """Spark ML's count vectors as ``features``; the order of equally frequent terms is Spark's choice.

    Spark ML brings the ``size`` terms of its vocabulary to the driver, so the caller says how many there may be;
    ``count_vectors`` has no such bound.
    """
    stages = [
        RegexTokenizer(inputCol="_clean", outputCol="words_token", pattern=r"\W"),
        StopWordsRemover(inputCol="words_token", outputCol="words_clean", stopWords=list(V.STOP_WORDS)),
        CountVectorizer(inputCol="words_clean", outputCol="features", vocabSize=size),
    ]
    cleaned = df.withColumn("_clean", clean_text(F.col(text)))
    return Pipeline(stages=stages).fit(cleaned).transform(cleaned).drop("_clean")
