"""Message job: captured messages to tagged and scored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dispatchmart.operators.sentiment import message_facts
from dispatchmart.operators.terms import add_features, add_tag


def score_messages(
    messages: DataFrame, lexicon: DataFrame, text: str = "tweet", key: str | None = None, features: int | None = None
) -> DataFrame:
    """Cleaned text, tag from the messages' own leading terms, polarity and subjectivity.

    ``features`` asks for count vectors of so many terms at most.
    """
    tagged = add_tag(messages, text=text)
    if features:
        tagged = add_features(tagged, features, text).drop("words_token", "words_clean")
    return message_facts(tagged, lexicon, text, key)
