"""What the operators share: shared-folder tables, words, integer hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut import session
from roughcut.functions import ranking

# A word is a maximal run of ASCII letters, digits and underscores or of any
# characters beyond ASCII, in lower case. This pattern matches what separates words.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def stored(df: DataFrame, name: str) -> DataFrame:
    """An intermediate table of these operators, in the application's part of the shared
    folder (see :func:`roughcut.session.stored` and ``drop_scratch``)."""
    return session.stored(df, "llm", name)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null text: empty array)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def words_sql(text: str) -> str:
    """DuckDB SQL for :func:`words`."""
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{WORD_GAP}'), lambda x: x <> '')"


def hash60(key: Column) -> Column:
    """A 60-bit integer from the md5 of a string; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")



def numbered(df: DataFrame, group: list[str], order: list[str], out: str, name: str,
             few: bool = False) -> DataFrame:
    """See :func:`roughcut.functions.ranking.numbered`."""
    return ranking.numbered(df, group, order, out, "llm", name, few=few)
