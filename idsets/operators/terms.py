"""Synonyms, normalised terms, phrases and repeated contexts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsets.operators.idset import IdSet


class Synonyms:
    """(term_id, synonyms) rows: of several entries for a term the first by ordinal."""

    def __init__(self, entries: DataFrame):
        """entries: (ordinal, term_id, synonyms array<bigint>)."""
        first = entries.groupBy("term_id").agg(F.min_by("synonyms", "ordinal").alias("synonyms"))
        self.entries, self.df = entries, first

    def __len__(self) -> int:
        return self.entries.count()

    def of(self, terms: DataFrame) -> DataFrame:
        """terms (term_id) with their synonyms; null if there is no entry."""
        return terms.join(self.df, "term_id", "left")

    def expand(self, terms: DataFrame) -> DataFrame:
        """(term_id, place, id): each term itself at place 0, then its synonyms."""
        own = self.of(terms).withColumn("all", F.concat(F.array("term_id"), F.coalesce("synonyms", F.array().cast("array<bigint>"))))
        return own.select("term_id", F.posexplode("all").alias("place", "id"))

    def search(self, terms: DataFrame, ids: IdSet) -> DataFrame:
        """The rows of expand whose id is in the set."""
        return self.expand(terms).join(ids.df, "id", "left_semi").select("term_id", "place", "id")


def normalised(term: Column) -> Column:
    """Lower case, trimmed, white space as single spaces; see composed for NFC."""
    return F.trim(F.regexp_replace(F.lower(term), "\\s+", " "))


def composed(term: Column) -> Column:
    """NFC, which has no built-in function: a vectorised UDF."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc(term)


def shingles(docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, shingle) of each `size` consecutive words of the normalised text."""
    words = F.filter(F.split(normalised(F.col(text)), " "), lambda w: w != "")
    rows = docs.select(F.col(id_column).alias("id"), words.alias("w")).filter(F.size("w") >= size)
    places = F.sequence(F.lit(1), F.size("w") - (size - 1))
    return rows.select("id", F.posexplode(F.transform(places, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("place", "shingle"))


def phrase_matches(docs: DataFrame, phrase: str, id_column: str = "doc_id", text: str = "text") -> IdSet:
    """The documents with the phrase's words in order: one scan, no index. Texts are normalised only where they have all of the words."""
    wanted = phrase.lower().split()
    lower = F.lower(F.col(text))
    some = reduce(lambda a, w: a & lower.contains(w), sorted(set(wanted), key=len, reverse=True), F.lit(True))
    words = F.concat(F.lit(" "), normalised(F.col(text)), F.lit(" "))
    return IdSet.from_column(docs.filter(some & words.contains(f" {' '.join(wanted)} ")), id_column)


def window_candidates(postings: DataFrame, windows: list[str]) -> IdSet:
    """The ids that have all windows in (id, shingle) postings, by one aggregate."""
    different = sorted(set(windows))
    hit = postings.filter(F.col("shingle").isin(different)).groupBy("id").agg(F.countDistinct("shingle").alias("n"))
    return IdSet(hit.filter(F.col("n") == len(different)).select("id"))


def distinct_contexts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, copies) of the different normalised texts: the least id of each and how many rows have it."""
    key = F.sha2(normalised(F.coalesce(F.col(text), F.lit(""))), 256)
    return docs.groupBy(key.alias("key")).agg(F.min(id_column).alias("id"), F.count("*").alias("copies")).select("id", "copies")
