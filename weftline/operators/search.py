"""Search of state spaces: a frontier of paths, one round of expansion at a time, for any number of starts at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import checkpoint


def search(
    starts: DataFrame,
    expand: Callable[[Column], Column],
    goal: Callable[[Column], Column],
    score: Callable[[Column], Column] | None = None,
    beam: int | None = None,
    minimize: bool = True,
    max_depth: int = 50,
    first: bool = True,
    eager: bool = False,
    heuristic: Callable[[Column], Column] | None = None,
    sample: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Rows (id, state, depth, score, path) of the goals that are reached from ``starts`` (id, state).

    ``expand`` maps a state to an array of states; states are visited once for
    each id, the one of the least depth (ties: best score, then least path)
    counting.  Without ``beam`` all states of a depth are expanded
    (breadth-first); with one, only its best of each id (1 is hill climbing);
    ``eager`` drops states worse than the best before.  ``heuristic`` is added
    to the score in choosing, as in A*; ``sample`` keeps each state with that
    probability by a seeded hash.  ``first`` ends an id once it has a goal.

    A round is one anti-join on (id, state) with the visited and, for a beam,
    one ranking; both frontier and visited are kept in the shared folder.
    """
    score = score or (lambda s: F.lit(0.0))
    h = heuristic or (lambda s: F.lit(0.0))
    sign = 1.0 if minimize else -1.0

    def rows(df: DataFrame, depth: int) -> DataFrame:
        s = F.col("state")
        return df.select("id", "state", F.lit(depth).alias("depth"), score(s).cast("double").alias("score"), (sign * (score(s) + h(s)).cast("double")).alias("_rank"), "path")

    front = checkpoint(rows(starts.select("id", "state", F.array("state").alias("path")).dropDuplicates(["id", "state"]), 0))
    visited = front.select("id", "state")
    found = front.where(goal(F.col("state")))
    if first:
        front = front.join(found.select("id").distinct(), "id", "left_anti")
    for depth in range(1, max_depth + 1):
        nxt = front.select("id", F.col("score").alias("_was"), F.col("path").alias("_p"), F.explode(expand(F.col("state"))).alias("state"))
        new = rows(nxt.select("id", "state", "_was", F.concat("_p", F.array("state")).alias("path")), depth)
        if eager:
            best = front.groupBy("id").agg(F.min("_rank").alias("_best"))
            new = new.join(best, "id").where("_rank <= _best").drop("_best")
        one = Window.partitionBy("id", "state").orderBy("_rank", "path")
        new = new.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k").join(visited, ["id", "state"], "left_anti")
        if sample is not None:
            u = F.pmod(F.xxhash64(F.lit(seed), "id", "state"), F.lit(1 << 20)) / float(1 << 20)
            new = new.where(u < sample)
        if beam is not None:
            w = Window.partitionBy("id").orderBy("_rank", "path")
            new = new.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= beam).drop("_k")
        front = checkpoint(new.select("id", "state", "depth", "score", "_rank", "path"))
        if front.isEmpty():
            break
        hits = front.where(goal(F.col("state")))
        found = found.unionByName(hits)
        visited = checkpoint(visited.unionByName(front.select("id", "state")))
        if first:
            front = front.join(hits.select("id").distinct(), "id", "left_anti")
    return found.select("id", "state", "depth", "score", "path")


def breadth_first(starts: DataFrame, expand, goal, **how) -> DataFrame:
    return search(starts, expand, goal, **how)


def depth_first(starts: DataFrame, expand, goal, **how) -> DataFrame:
    """All goals in the order in which a depth-first walk meets them: by path, a path before those it begins."""
    return search(starts, expand, goal, first=False, **how).orderBy("id", "path")


def iterative_deepening(starts: DataFrame, expand, goal, limits: range, **how) -> DataFrame:
    """Goals within the first depth limit that has any for an id; rounds share their work, as depths are rounds."""
    got = search(starts, expand, goal, first=True, max_depth=limits[-1], **how)
    step = F.array(*map(F.lit, limits))
    return got.withColumn("limit", F.element_at(F.filter(step, lambda x: x >= F.col("depth")), 1))


def beam_search(starts: DataFrame, expand, goal, score, beam: int, **how) -> DataFrame:
    return search(starts, expand, goal, score, beam=beam, **how)


def hill_climbing(starts: DataFrame, expand, goal, score, **how) -> DataFrame:
    return search(starts, expand, goal, score, beam=1, eager=True, **how)


def astar(starts: DataFrame, expand, goal, cost, heuristic, **how) -> DataFrame:
    return search(starts, expand, goal, cost, heuristic=heuristic, **how)


def swapped_neighbours(state: Column) -> Column:
    """Every order of an array of tokens with two neighbours swapped."""
    n = F.size(state)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.slice(state, F.lit(1), i - 1), F.array(F.get(state, i), F.get(state, i - 1)), F.slice(state, i + 2, n)))
