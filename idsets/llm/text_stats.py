"""Statistics of texts as DataFrame columns, over whole texts, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among these."""
    if len(characters) == 1:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(characters), F.lit("")))
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def with_words(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns`, and as __text, __words and __lines the text (null: empty), its words and those of its lines that have a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*columns, text.alias("__text"), F.btrim(text, F.lit(SPACE)).alias("__trimmed"))
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", "[ \\t\\n\\x0B\\f\\r]+"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return rows.select(*columns, "__text", words.alias("__words"), lines.alias("__lines"))
