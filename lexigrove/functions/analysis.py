"""The analysis chain, normalise, tokenise, strip, stop and stem, as column expressions.

The whole chain stays in the JVM. Stemming, a longer one, runs on the dictionary of distinct tokens (see stemmed()), so once per
token and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.stemmer import stem

# Fixed values of the Arabic chain.
HAMZA_FROM, HAMZA_TO = "إأآى", "اااي"
MARKS = r"[ً-ٰٟ]"
TATWEEL = "ـ"
PUNCTUATION = r"[،؛؟؞ـ!-/:-@\[-`{-~٪-٬]"
ARABIC_TOKEN = r"[؀-ۿ0-9]+"
ARTICLES = ("ال", "إل", "أل", "لل")
NEGATION = "لا"
ARABIC_TERM = r"^[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿0-9]+$"
LATIN_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Profile:
    """What the chain does: `arabic` is the parity profile; `digits` and `latin` serve text without Arabic."""

    name: str
    stopwords: frozenset[str] = frozenset()
    protected: frozenset[str] = frozenset()
    stems: bool = False
    protect: bool = True

    def with_lexicons(self, stopwords: Iterable[str] = (), protected: Iterable[str] = ()) -> Profile:
        return replace(self, stopwords=frozenset(stopwords), protected=frozenset(protected))


ARABIC = Profile("arabic", stems=True)
DIGITS = Profile("digits")
LATIN = Profile("latin")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Arabic normalisation; null gives the empty string."""
    plain = F.translate(F.coalesce(c, F.lit("")), HAMZA_FROM, HAMZA_TO)
    return squeeze(F.regexp_replace(plain, f"{MARKS}|{TATWEEL}", ""))


clean_term = normalize


def strip_article(c: Column) -> Column:
    """One leading article off, where something remains; else a leading negation off words longer than it."""
    return F.when(c.rlike(f"^({'|'.join(ARTICLES)})."), F.substring(c, 3, 2**31 - 1)).when(c.rlike(f"^{NEGATION}."), F.substring(c, 3, 2**31 - 1)).otherwise(c)


def unpunctuated(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def tokenize(c: Column, profile: Profile) -> Column:
    """array<string>: the tokens before stopword removal."""
    if profile.name == "latin":
        return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({LATIN_TOKEN})"), 1)
    if profile.name == "digits":
        return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({ARABIC_TOKEN})"), 1)
    found = F.regexp_extract_all(unpunctuated(normalize(c)), F.lit(f"({ARABIC_TOKEN})"), 1)
    return F.filter(F.transform(found, strip_article), lambda t: t != "")


def remove_stopwords(tokens: Column, profile: Profile) -> Column:
    """Repeats stay, so positions count what is left."""
    if not profile.stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(sorted(profile.stopwords)))


def analyze(c: Column, profile: Profile) -> Column:
    """array<string>: the chain up to, and without, stemming."""
    return remove_stopwords(tokenize(c, profile), profile)


def is_protected(c: Column, profile: Profile) -> Column:
    return normalize(strip_article(c)).isin(sorted(profile.protected)) if profile.protected else F.lit(False)


def has_foreign(term: Column) -> Column:
    """Whether a term has a character outside the Arabic blocks and ASCII digits."""
    return ~term.rlike(ARABIC_TERM)


def stemmed(tokens: DataFrame, column: str, profile: Profile, to: str = "term") -> DataFrame:
    """`tokens` with column `to`: the stem of `column`, found once for each distinct token.

    With protection, protected tokens stay and stems under two letters give way to their token; without it, or with no
    protected words, any stem that isn't empty stands. The dictionary is joined back on the token; AQE broadcasts it
    where its size allows.
    """
    if not profile.stems:
        return tokens.withColumn(to, F.col(column))
    words = tokens.select(F.col(column).alias("__token")).distinct()
    found = _chosen(words.withColumn("__stem", stem(F.col("__token"))), "__token", profile)
    return tokens.join(found.select("__token", F.col("__term").alias(to)), F.col(column) == F.col("__token")).drop("__token")


def stemmed_rows(rows: DataFrame, column: str, profile: Profile, to: str = "term") -> DataFrame:
    """`rows` with column `to`: the stem of `column` as by stemmed(), found in each row, where few rows share a token."""
    return _chosen(rows.withColumn("__stem", stem(F.col(column))), column, profile).withColumnRenamed("__term", to).drop("__stem")


def _chosen(words: DataFrame, column: str, profile: Profile) -> DataFrame:
    """`words` (column, __stem) with __term: the stem, or the token where that stays."""
    guarded = profile.protect and bool(profile.protected)
    long_enough = F.length("__stem") >= (2 if guarded else 1)
    stays = is_protected(F.col(column), profile) if guarded else F.lit(False)
    return words.withColumn("__term", F.when(~stays & long_enough, F.col("__stem")).otherwise(F.col(column)))


def analyze_texts(spark: SparkSession, texts: list[str], profile: Profile) -> list[list[str]]:
    """The terms of a few short texts, such as the operands of a query; the same chain as for documents."""
    if not texts:
        return []
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.posexplode(analyze(F.col("text"), profile)).alias("at", "__token"))
    rows = _chosen(rows.withColumn("__stem", stem(F.col("__token"))), "__token", profile) if profile.stems else rows.withColumn("__term", F.col("__token"))
    out: list[list[str]] = [[] for _ in texts]
    for r in rows.select("i", "at", "__term").orderBy("i", "at").collect():
        out[r["i"]].append(r["__term"])
    return out


analyze_for_indexing = analyze
analyze_for_query = analyze
