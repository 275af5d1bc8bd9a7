"""Line deduplication with bitmaps of kept lines.

Hashes of the long enough lines are dealt out by range and sorted by hash, document
and position, so one pass meets a line's documents one after the other and sees the
first occurrence in each. A salt of the document in the range key splits a line that
very many documents hold; the salted groups are summed before they meet. Only marks
travel to the documents, 64 lines to a number, and only for stretches that lose a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collabnet.session import stored

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
SALTS = 64
WORD = 64

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A to Z in lower case."""
    stripped = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, version, n_dropped, keep) of the documents that lose a line.

    A line whose key has ``min_length`` code points and stands in ``min_documents``
    documents is kept in the largest id only, there at all its places. Bit i of
    ``keep[w]`` is 1 if line 64 w + i stays; lines of a missing w all stay. ``version``
    is the hash of the text, so rows that share an id but not a text have bitmaps of
    their own; such rows count as one document, equal rows have the same bitmap. Rows
    without an id or a text have nothing to lose.
    """
    lines = docs.where(F.col(id).isNotNull()).select(
        F.col(id).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(lines_of(F.col(text))).alias("pos", "line")
    )
    keyed = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    marks = stored(  # read three times, by the sampling of the ranges too
        keyed.select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"),
            "doc",
            "version",
            "pos",
        )
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marks.repartitionByRange(n, "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc").desc(), "version", "pos")
    first = ~F.lag("doc").over(stream).eqNullSafe(F.col("doc"))
    met = dealt.withColumn("first", first.cast("bigint"))
    groups = met.groupBy("h1", "h2", "salt").agg(F.sum("first").alias("n"), F.max("doc").alias("last"))
    repeated = groups.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("keeper")).where(F.col("n") >= min_documents)
    # the salt is part of the join key, so a hot line's marks stay dealt out
    salted = groups.select("h1", "h2", "salt").join(repeated.select("h1", "h2", "keeper"), ["h1", "h2"])
    dropped = marks.join(salted, ["h1", "h2", "salt"]).where(F.col("doc") != F.col("keeper"))
    one = F.lit(1).cast("bigint")
    words = dropped.groupBy("doc", "version", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("pos") % WORD)).alias("bits")
    )
    return words.groupBy("doc", "version").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("keep"),
    )


def kept_text(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again."""

    def stays(_: Column, i: Column) -> Column:
        word = F.try_element_at(keep, F.floor(i / WORD).cast("int"))
        return F.coalesce(F.getbit(word, i % WORD) == 1, F.lit(True))

    return F.array_join(F.filter(lines, stays), "\n")


def dedup_lines(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with its columns, ``kept_text``, ``n_lines`` and ``n_dropped``.

    Null and empty texts are one empty line. Other columns pass through, whatever
    their names are, and are nested in ``row`` to that end.
    """
    bitmaps = keep_bitmaps(docs, min_length, min_documents, id, text)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("doc"), F.xxhash64(text).alias("version"))
    # without an id there is no partner; the hash keeps such rows from meeting in one task
    known = rows.where(F.col("doc").isNotNull()).join(bitmaps, ["doc", "version"], "left")
    joined = known.unionByName(rows.where(F.col("doc").isNull()), allowMissingColumns=True)
    lines, whole = lines_of(F.col(f"row.{text}")), F.coalesce(F.col(f"row.{text}"), F.lit(""))
    return joined.select(
        "row",
        F.when(F.col("keep").isNull(), whole).otherwise(kept_text(lines, F.col("keep"))).alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with its columns, the text less the lines that are dropped; ``size``, if there is one, is its length."""
    rows = dedup_lines(docs, id=id, text=text)
    made = {text: F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col(f"row.{text}"))}
    if size in docs.columns:
        changed = F.length("kept_text").cast(docs.schema[size].dataType)
        made[size] = F.when(F.col("n_dropped") > 0, changed).otherwise(F.col(f"row.{size}"))
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
