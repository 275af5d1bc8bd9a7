"""Who took part in the same event with whom.

Events (releases) differ wildly in size, so nothing here joins a whole event
with itself inside one task: large events are cut into blocks of participants
and every pair of blocks becomes a join key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collabnet.session import cut_lineage, spread

BLOCK = 512


def participations(credits: DataFrame, entity: str, event: str) -> DataFrame:
    """Distinct (event, entity) rows, without nulls."""
    return _named(credits, entity, event).distinct()


def _named(credits: DataFrame, entity: str, event: str) -> DataFrame:
    return credits.select(F.col(event).alias("event"), F.col(entity).alias("entity")).where(
        F.col("event").isNotNull() & F.col("entity").isNotNull()
    )


def _load(rows: DataFrame) -> tuple[int, float]:
    """Rows of the largest event, and the rows and pairs of all; one narrow pass with map-side combine."""
    n = F.col("count").cast("double")
    found = rows.groupBy("event").count().agg(F.max("count").alias("largest"), F.sum(n * (n + 1) / 2).alias("load")).first()
    return found.largest or 0, found.load or 0.0


def _block_cells(parts: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Each participant once per block pair (lo, hi) it belongs to, as left and right side."""
    sizes = parts.groupBy("event").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    large = sizes.where(F.col("blocks") > 1)
    placed = (
        parts.join(large, "event", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    )
    left = placed.select(
        "event",
        F.col("own").alias("lo"),
        F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"),
        F.col("entity").alias("a"),
    )
    right = placed.select(
        "event",
        F.explode(F.sequence(F.lit(0), F.col("own"))).alias("lo"),
        F.col("own").alias("hi"),
        F.col("entity").alias("b"),
    )
    return left, right


def _meetings(parts: DataFrame, block: int, load: float) -> DataFrame:
    """One row (src, dst, event) per event and unordered pair of its participants, ``src < dst``."""
    cell = ["event", "lo", "hi"]
    left, right = (spread(side, load, *cell) for side in _block_cells(parts, block))
    # The cells repeat rows, which size estimates do not see: never broadcast them.
    met = left.join(right.hint("merge"), cell).where(
        ((F.col("lo") < F.col("hi")) & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))
    )
    return met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "event")


def _small_meetings(rows: DataFrame, load: float) -> DataFrame:
    """The same where no event is large: one shuffle by event serves the distinct and the join."""
    parts = spread(rows, load, "event").distinct()
    return (
        parts.withColumnRenamed("entity", "src")
        .join(parts.withColumnRenamed("entity", "dst"), "event")
        .where(F.col("src") < F.col("dst"))
        .select("src", "dst", "event")
    )


def pair_events(credits: DataFrame, entity: str, event: str, block: int = BLOCK) -> DataFrame:
    """Long form of the played-with relation: (src, dst, event), ``src < dst``."""
    return _pair_events(_named(credits, entity, event), block)[0]


def _pair_events(rows: DataFrame, block: int) -> tuple[DataFrame, float]:
    """Long form of the relation and about how many rows it has."""
    largest, load = _load(rows)
    if largest > block:
        return _meetings(rows.distinct(), block, load), load
    return _small_meetings(rows, load), load


def pair_summary(credits: DataFrame, entity: str, event: str, *summary: Column, block: int = BLOCK) -> DataFrame:
    """(src, dst) with aggregates over ``event``, the common events of every pair."""
    met, load = _pair_events(_named(credits, entity, event), block)
    return spread(met, load, "src", "dst").groupBy("src", "dst").agg(*summary)


def pair_counts(
    credits: DataFrame, entity: str, event: str, min_common: int = 1, block: int = BLOCK
) -> DataFrame:
    """(src, dst, n_common) for the pairs with at least ``min_common`` common events.

    Where large events exist and ``min_common = n > 1``, the n - 1 most crowded
    events of every entity are left out when candidates are made: two entities
    that share n events share at least one beyond these. The left-out events are
    then looked up for the candidates only, so the crowded events are never
    expanded and the counts stay exact.
    """
    rows = _named(credits, entity, event)
    largest, load = _load(rows)
    if largest <= block or min_common <= 1:
        met = _small_meetings(rows, load) if largest <= block else _meetings(rows.distinct(), block, load)
        return _counted(met, load).where(F.col("n_common") >= min_common)

    parts = cut_lineage(rows.distinct())
    kept, left_out = _split_crowded(parts, min_common - 1)
    _, load = _load(kept)
    met = cut_lineage(_counted(_meetings(kept, block, load), load))
    # At most min_common - 1 rows per entity are probed here.
    a_out = left_out.select(F.col("entity").alias("src"), "event")
    b_out = left_out.select(F.col("entity").alias("dst"), "event")
    via_a = met.select("src", "dst").join(a_out, "src").join(
        parts.select(F.col("entity").alias("dst"), "event"), ["dst", "event"], "left_semi"
    )
    via_b = met.select("src", "dst").join(b_out, "dst").join(
        kept.select(F.col("entity").alias("src"), "event"), ["src", "event"], "left_semi"
    )
    one = F.lit(1).cast("bigint").alias("n_common")
    return (
        met.unionByName(via_a.select("src", "dst", one))
        .unionByName(via_b.select("src", "dst", one))
        .groupBy("src", "dst")
        .agg(F.sum("n_common").alias("n_common"))
        .where(F.col("n_common") >= min_common)
    )


def _counted(met: DataFrame, load: float) -> DataFrame:
    return spread(met, load, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n_common"))


def _split_crowded(parts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Split (event, entity) rows into all but, and only, the ``k`` most crowded events per entity.

    Spark limits the groups of such a rank filter before the shuffle, so even an
    entity with very many events brings only k rows per map task to its window.
    """
    sizes = parts.groupBy("event").agg(F.count("*").alias("size"))
    crowded = Window.partitionBy("entity").orderBy(F.col("size").desc(), F.col("event").desc())
    left_out = cut_lineage(
        parts.join(sizes, "event")
        .withColumn("place", F.row_number().over(crowded))
        .where(F.col("place") <= k)
        .select("event", "entity")
    )
    kept = parts.join(left_out, ["event", "entity"], "left_anti")
    return kept, left_out


def pair_lists(credits: DataFrame, entity: str, event: str, out: str = "id_releases") -> DataFrame:
    """Pairs with the sorted array of their common events.

    A view for readers of the array form; the operators work on the long form.
    """
    return pair_summary(credits, entity, event, F.array_sort(F.collect_list("event")).alias(out))


def pair_titles(pairs: DataFrame, titles: DataFrame, event: str = "event", title: str = "title") -> DataFrame:
    """Attach event titles to pairs in long form (J13, A10): (src, dst, event, title), distinct."""
    return (
        pairs.join(titles.select(F.col(event).alias("event"), F.col(title).alias("title")), "event")
        .select("src", "dst", "event", "title")
        .distinct()
    )


def title_lists(titled: DataFrame) -> DataFrame:
    """Edges with ``id_title_list``, the array of (id_release, title) of their common events.

    A view for readers of the array form; the operators work on the long form.
    """
    return titled.groupBy("src", "dst").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("event").alias("id_release"), F.col("title").alias("title")))
        ).alias("id_title_list")
    )


def at_least(min_common: int, n_common: str = "n_common") -> Column:
    """Inclusive edge-weight predicate."""
    return F.col(n_common) >= min_common
