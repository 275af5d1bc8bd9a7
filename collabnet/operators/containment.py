"""Which texts contain which words or match which patterns, by an index of trigrams.

Texts and words are tables. The distinct texts are indexed by their runs of three
characters; a word is looked up by the rarest of its own runs, and what that finds is
verified. So neither side is a list in a plan, and a word meets only texts that share a
rare run with it. Shorter words are looked up whole among runs of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.session import stored, union_all

GRAM = 3


def _grams(rows: DataFrame, text: str, size: int) -> DataFrame:
    """(text, gram): the distinct runs of ``size`` characters of texts at least that long, each cut into characters once."""
    cut = rows.where(F.length(text) >= size).select(text, F.split(text, "").alias("_letters"))
    at = F.sequence(F.lit(0), F.length(text) - size)
    runs = F.transform(at, lambda i: F.concat(*[F.get("_letters", i + k) for k in range(size)]))
    return cut.select(text, F.explode(F.array_distinct(runs)).alias("gram"))


def contained(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, word): every distinct text with every distinct word that it contains.

    Nulls take no part; the empty word is in every text.
    """
    texts = stored(texts.select("text").where(F.col("text").isNotNull()).distinct())
    words = stored(words.select("word").where(F.col("word").isNotNull()).distinct())
    size = F.least(F.length("word"), F.lit(GRAM))
    everywhere = texts.withColumn("word", F.lit(""))
    found = [everywhere.where(F.lit(not words.where(F.col("word") == "").isEmpty()))]
    for n in range(1, GRAM + 1):
        own = words.where(size == n)
        if own.isEmpty():
            continue
        asked = _grams(own, "word", n)
        held = stored(_grams(texts, "text", n).join(asked.select("gram").distinct(), "gram", "left_semi"))
        counts = held.groupBy("gram").agg(F.count("*").alias("df"))
        probes = asked.join(counts, "gram", "left").groupBy("word").agg(
            F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.bool_and(F.col("df").isNotNull()).alias("known")
        )
        near = held.join(probes.where("known"), "gram")  # a word with a run that no text has is in none
        found.append(near.where(F.contains("text", F.col("word"))).select("text", "word"))
    return union_all(found)


def literal_run(pattern: Column) -> Column:
    """The longest plain text that every match of a pattern contains; empty where none is certain.

    Alternatives, groups and escapes make nothing certain; elsewhere whatever is optional,
    a set or a wildcard parts the plain runs.
    """
    plain = F.regexp_replace(pattern, r"(\[[^\]]*\]|.)(\?|\*|\{[^}]*\})", ".")
    plain = F.regexp_replace(plain, r"\[[^\]]*\]", ".")
    runs = F.split(plain, r"[.^$+]")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    return F.when(pattern.rlike(r"[|()\\]"), F.lit("")).otherwise(longest)


def matching(texts: DataFrame, terms: DataFrame, literal: bool = False) -> DataFrame:
    """(text, term): every distinct text with every distinct term that it contains, or as a pattern matches."""
    asked = terms.select("term").where(F.col("term").isNotNull()).distinct()
    asked = asked.withColumn("word", F.col("term") if literal else literal_run(F.col("term")))
    near = contained(texts, asked.select("word")).join(asked, "word").select("text", "term")
    return near if literal else near.where(F.rlike("text", F.col("term")))
