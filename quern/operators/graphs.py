"""Reachability and components over edges as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written


def hops(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids (a) that share a neighbour (b) with one of the starts: two semi-joins, so no pairs are made."""
    near = edges.join(starts, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
    return edges.join(near, F.col("b") == F.col("id"), "left_semi").select(F.col("a").alias("id")).distinct()


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges (parent, child) reach from the starts, these included: one join a level, until there are no new ids."""
    edges = written(edges.select("parent", "child"))
    found = new = written(starts.select("id").distinct())
    while not new.isEmpty():
        new = edges.join(new, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id")).distinct()
        new = written(new.join(found, "id", "left_anti"))
        found = found.union(new)
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of the ids in links (a, b): the smallest id that links reach, by turns of large and small stars,
    until a round changes nothing."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    wide = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")) for seed in (1, 2)]
    state, now = None, edges.agg(F.count("*"), *wide).first()
    while now != state and now[0]:
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), *wide).first()
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return found.union(edges.select("v", "v")).distinct()


def communities(edges: DataFrame) -> DataFrame:
    """(id, community_id, size) of the ids in edges (a, b): communities by label propagation, named by their least member.

    In each round the ids take their turns in order; each adopts the label that most of its neighbours have just now
    (the least of several), if they are as many at least as have its own. Rounds end when none changes anything.

    The turns of a round are not taken one by one. All ids decide at once on a guess of the new labels of the ids before
    them and the old ones of those after; the guess is replaced by what they decide until it stays. What stays is what
    the turns give: the first id's label is right after one step, and every id's once those before it are.
    """
    both = edges.where("a != b").select(F.col("a").alias("n"), F.col("b").alias("m"))
    both = written(both.union(both.select("m", "n")).distinct())
    labels = written(both.select("n").distinct().select("n", F.col("n").alias("old"), F.col("n").alias("new")))
    while True:
        # One round.
        while True:
            near = both.join(labels.select(F.col("n").alias("m"), "old", "new"), "m")
            counts = near.groupBy("n", F.when(F.col("m") < F.col("n"), F.col("new")).otherwise(F.col("old")).alias("label")).agg(F.count("*").alias("c"))
            own = labels.select("n", "old", F.col("new").alias("guess"))
            best = counts.join(own, "n").groupBy("n", "old", "guess").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("label").alias("label"))).alias("best"), F.max(F.when(F.col("label") == F.col("old"), F.col("c"))).alias("own"))
            label = F.when(-F.col("best.c") >= F.coalesce("own", F.lit(0)), F.col("best.label")).otherwise(F.col("old"))
            told = written(best.select("n", "old", label.alias("new"), (label != F.col("guess")).alias("moved")))
            dropped(labels)
            labels = told
            if told.where("moved").isEmpty():
                break
        if labels.where("new != old").isEmpty():
            break
        settled = written(labels.select("n", F.col("new").alias("old"), "new"))
        dropped(labels)
        labels = settled
    groups = labels.groupBy("new").agg(F.min("n").alias("community_id"), F.count("*").alias("size"))
    return labels.join(groups, "new").select(F.col("n").alias("id"), "community_id", "size")
