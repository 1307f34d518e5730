"""Tokens, shingles and reply parsing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"
WORD_OR_APOSTROPHE = "[a-z0-9']+"


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def shingles(words: Column, width: int, *, keep_short: bool) -> Column:
    """Every run of ``width`` words joined by blanks, as an array.

    A text with fewer words gives its whole word list as one shingle when
    ``keep_short``, and nothing otherwise; no words give nothing.
    """
    count = F.size(words)
    whole = F.array(F.array_join(words, " "))
    empty = F.array().cast("array<string>")
    runs = F.transform(
        F.sequence(F.lit(1), count - width + 1),
        lambda i: F.array_join(F.slice(words, i, width), " "),
    )
    short = F.when(count == 0, empty).otherwise(whole) if keep_short else empty
    return F.when(count >= width, runs).otherwise(short)


def shingle_rows(
    texts: DataFrame, key: str, text: str, width: int, *, pattern: str = WORD, keep_short: bool = True
) -> DataFrame:
    """Distinct (key, shingle) rows; distinct within each text before any shuffle."""
    words = texts.select(key, tokens(F.col(text), pattern).alias("_words"))
    return words.select(
        key, F.explode(F.array_distinct(shingles(F.col("_words"), width, keep_short=keep_short))).alias("shingle")
    )


def is_json(text: Column) -> Column:
    """True when the whole text is one JSON value.

    The parser stops after the first complete value, so the text is tried inside an
    array and inside an object: what follows a value spoils at least one of the two.
    """
    in_array, in_object = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"a":'), text, F.lit("}"))
    whole = F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()
    return F.coalesce(whole & (F.json_array_length(in_array) == 1), F.lit(False))


def parse_reply(body: Column, finish: Column) -> Column:
    """A model reply as a struct(json, reason): one enclosing Markdown fence is removed.

    reason is response_token_limit, invalid_response (no text at all) or
    invalid_json; NULL when the rest is JSON.
    """
    text = F.trim(body)
    is_fenced = text.startswith("```") & text.endswith("```")
    # Between the first line, which may name a language, and the closing fence.
    inside = F.trim(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```$", 1))
    inner = F.when(is_fenced, inside).otherwise(text)
    reason = (
        F.when(finish == "length", "response_token_limit")
        .when(body.isNull(), "invalid_response")
        .when(~is_json(inner), "invalid_json")
    )
    return F.struct(F.when(reason.isNull(), inner).alias("json"), reason.alias("reason"))
