"""Path counts, scores and the best paths from the arcs of all shortest paths.

A path is never a row here until it is asked for. The number of paths through a vertex
is the number of ways down to it times the ways on from it. A path's score is a sum over
its inner vertices, so the best distinct scores of a vertex's tails are the best of its
successors' with their values added: each vertex keeps at most as many scores as ranks
are asked, with the number of tails for each. Counts are decimals of 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collabnet.operators.paths import PathDag
from collabnet.session import stored, union_all

PAIR = ["relevant", "guest"]
COUNT = "decimal(38,0)"


def _one() -> Column:
    return F.lit(1).cast(COUNT)


def _sum(column: str) -> Column:
    return F.sum(column).cast(COUNT).alias(column)


def ways_on(dag: PathDag) -> dict[int, DataFrame]:
    """By distance: (relevant, id, ways), the number of tails from a vertex to the relevant."""
    found: dict[int, DataFrame] = {}
    for d, arcs in sorted(dag.arcs.items()):
        if d == 1:
            steps = arcs.select("relevant", "id", _one().alias("ways"))
        else:
            steps = arcs.join(found[d - 1].withColumnRenamed("id", "dst"), ["relevant", "dst"])
        found[d] = stored(steps.groupBy("relevant", "id").agg(_sum("ways")))
    return found


def ways_down(dag: PathDag) -> dict[int, DataFrame]:
    """By distance: (relevant, guest, id, ways), the number of ways from the guest to a vertex on its paths."""
    found: dict[int, DataFrame] = {}
    reached = None
    for d, arcs in sorted(dag.arcs.items(), reverse=True):
        here = dag.ends[d].select(*PAIR, F.col("guest").alias("id"), _one().alias("ways"))
        found[d] = here if reached is None else stored(here.unionByName(reached))
        steps = found[d].join(arcs, ["relevant", "id"])
        reached = steps.groupBy(*PAIR, F.col("dst").alias("id")).agg(_sum("ways"))
    return found


def pair_counts(dag: PathDag) -> DataFrame:
    """(guest, relevant, key, n_paths): how many shortest paths a pair has."""
    tails = ways_on(dag)
    parts = [dag.ends[0].select("guest", "relevant", F.lit(0).alias("key"), _one().alias("n_paths"))]
    for d, ways in tails.items():
        of = dag.ends[d].join(ways.withColumnRenamed("id", "guest"), PAIR)
        parts.append(of.select("guest", "relevant", F.lit(d - 1).alias("key"), F.col("ways").alias("n_paths")))
    return union_all(parts)


def paths_through(dag: PathDag) -> DataFrame:
    """(relevant, guest, id, n_paths): paths of the pair with ``id`` as an inner vertex."""
    tails, starts = ways_on(dag), ways_down(dag)
    none = dag.ends[0].where(F.lit(False))
    parts = [none.select(*PAIR, F.col("guest").alias("id"), _one().alias("n_paths"))]
    for d, down in starts.items():
        inner = down.where(F.col("id") != F.col("guest")).withColumnRenamed("ways", "down")
        both = inner.join(tails[d], ["relevant", "id"])
        parts.append(both.select(*PAIR, "id", (F.col("down") * F.col("ways")).cast(COUNT).alias("n_paths")))
    return union_all(parts)


def _with_value(arcs: DataFrame, values: DataFrame, d: int) -> DataFrame:
    """Arcs from distance d with the value that a path gains at ``dst``; the relevant at its end has none."""
    nothing = F.lit(0).cast(COUNT)
    if d == 1:
        return arcs.withColumn("value", nothing)
    at = values.withColumnRenamed("id", "dst")
    return arcs.join(at, [c for c in at.columns if c != "value"], "left").withColumn("value", F.coalesce("value", nothing))


@dataclass(frozen=True)
class BestPaths:
    """The ``top`` best distinct scores of every pair and what is needed to spell their paths out.

    ``tails[d]`` holds (keys, id, score, ways): scores of the tails from a vertex, its own
    value not counted. ``ranks`` is (relevant, guest, dist, rank, score, n_paths).
    """

    arcs: dict[int, DataFrame]
    keys: list[str]
    values: DataFrame
    tails: dict[int, DataFrame]
    ranks: DataFrame

    def _starts(self, d: int, *columns: str) -> DataFrame:
        ranked = self.ranks.where(F.col("dist") == d).withColumn("left", F.col("score") if d > 1 else F.lit(0).cast(COUNT))
        return ranked.select(*columns, F.col("guest").alias("id"), "left")

    def _step(self, state: DataFrame, d: int, keep: list[str]) -> DataFrame:
        """One arc further: only to vertices that have a tail of the score that is left."""
        steps = state.join(_with_value(self.arcs[d], self.values, d), [*self.keys, "id"])
        moved = steps.select(*dict.fromkeys([*self.keys, *keep]), F.col("dst").alias("id"), (F.col("left") - F.col("value")).cast(COUNT).alias("left"))
        if d == 1:
            return moved.where(F.col("left") == 0)
        open_ = self.tails[d - 1].select(*self.keys, "id", F.col("score").alias("left"))
        return moved.join(open_, [*self.keys, "id", "left"], "left_semi")

    def paths(self) -> DataFrame:
        """(path_id, guest, relevant, key, vertices, rank, score) of the ranked paths, and no others."""
        whole = [*PAIR, "rank", "score"]
        state = None
        for d in sorted(self.arcs, reverse=True):
            here = self._starts(d, *whole).withColumn("vertices", F.array("id"))
            state = here if state is None else here.unionByName(state)
            moved = self._step(state, d, [*whole, "vertices"])
            state = stored(moved.withColumn("vertices", F.concat("vertices", F.array("id"))))
        trivial = self.ranks.where("dist = 0").select(*whole, F.array("guest", "guest").alias("vertices"))
        found = trivial if state is None else state.select(*trivial.columns).unionByName(trivial)
        shown = found.select("guest", "relevant", (F.size("vertices") - 2).alias("key"), "vertices", "rank", "score")
        return stored(shown.withColumn("path_id", F.monotonically_increasing_id()))

    def load(self, groups: list[str] = ()) -> DataFrame:
        """(groups, id, bc): share of the ranked paths that contain the vertex (G17), without spelling them out."""
        groups = list(groups)
        keys = list(dict.fromkeys([*self.keys, *groups]))
        cell = [*keys, "id", "left"]
        parts, state = [], None
        shares = list(dict.fromkeys([*groups, "id"]))
        for d in sorted(self.arcs, reverse=True):
            here = self._starts(d, *keys).withColumn("ways", _one())
            state = here if state is None else here.unionByName(state)
            state = stored(state.groupBy(*cell).agg(_sum("ways")))
            on = state.withColumnRenamed("ways", "down").withColumnRenamed("left", "score").join(self.tails[d], [*self.keys, "id", "score"])
            parts.append(on.select(*shares, (F.col("down") * F.col("ways")).cast(COUNT).alias("n")))
            state = self._step(state, d, [*keys, "ways"])
        if state is not None:
            parts.append(state.select(*shares, F.col("ways").alias("n")))
        at_home = [F.col("guest").alias(c) if c == "id" else F.col(c) for c in shares]
        parts.append(self.ranks.where("dist = 0").select(*at_home, F.col("n_paths").alias("n")))
        through = union_all(parts).groupBy(*shares).agg(_sum("n"))
        if groups:
            totals = self.ranks.groupBy(*groups).agg(F.sum("n_paths").cast(COUNT).alias("total"))
            through = through.join(totals, groups)
        else:
            through = through.withColumn("total", self.ranks.agg(F.sum("n_paths").cast(COUNT)).scalar())
        return through.select(*shares, (F.col("n").cast("double") / F.col("total").cast("double")).alias("bc"))


def best_paths(dag: PathDag, values: DataFrame, top: int, per_pair: bool = False, bare: int = 1) -> BestPaths:
    """The paths of dense rank up to ``top`` by the sum of ``values`` over their inner vertices.

    ``values`` is (id, value), whole numbers, or with ``per_pair`` (relevant, guest, id,
    value); a vertex without one counts 0. Without ``per_pair`` the tails of a vertex
    serve all guests. ``bare`` is the score of a path without inner vertices.
    """
    lone = F.lit(bare).cast(COUNT)
    keys = PAIR if per_pair else ["relevant"]
    values = stored(values.withColumn("value", F.col("value").cast(COUNT)))
    arcs = dag.arcs
    if per_pair:
        starts = ways_down(dag)
        arcs = {d: starts[d].drop("ways").join(a, ["relevant", "id"]) for d, a in dag.arcs.items()}
    tails: dict[int, DataFrame] = {}
    order = Window.partitionBy(*keys, "id").orderBy(F.col("score").desc())
    ranks = [dag.ends[0].select(*PAIR, F.lit(0).alias("dist"), F.lit(1).alias("rank"), lone.alias("score"), _one().alias("n_paths"))]
    for d in sorted(arcs):
        steps = _with_value(arcs[d], values, d)
        if d == 1:
            steps = steps.withColumn("score", F.lit(0).cast(COUNT)).withColumn("ways", _one())
        else:
            after = tails[d - 1].withColumnRenamed("id", "dst").withColumnRenamed("score", "after")
            steps = steps.join(after, [*keys, "dst"]).withColumn("score", (F.col("after") + F.col("value")).cast(COUNT))
        scored = steps.groupBy(*keys, "id", "score").agg(_sum("ways"))
        tails[d] = stored(scored.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= top))
        of = tails[d].withColumnRenamed("ways", "n_paths")
        of = of.where(F.col("id") == F.col("guest")).drop("id") if per_pair else of.withColumnRenamed("id", "guest").join(dag.ends[d], PAIR, "left_semi")
        shown = F.col("score") if d > 1 else lone
        ranks.append(of.select(*PAIR, F.lit(d).alias("dist"), "rank", shown.alias("score"), "n_paths"))
    plain = {d: t.select(*keys, "id", "score", "ways") for d, t in tails.items()}
    return BestPaths(arcs, keys, values, plain, stored(union_all(ranks)))
