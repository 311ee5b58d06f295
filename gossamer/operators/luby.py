"""Maximal independent sets by Luby rounds, as a driver loop over DataFrames.

A round's state is the unassigned nodes (i, m, cf) and the edges between them.  A node's active
neighbours are reduced to the smallest (measure, id) by a partial aggregation,
so a hub's neighbours meet in no task; written tables cut the lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.randoms import TWO_32, random_int
from gossamer.plans.model import C_POINT, F_POINT
from gossamer.session import materialize


def rounds(edges: DataFrame, state: DataFrame, max_steps: int = -1, both_ways: bool = False) -> DataFrame:
    """state (i, m, assigned, cf) after Luby rounds over the edges (i, j): exactly max_steps, or until all are assigned if negative.

    In a round an unassigned node joins the set (cf = F) unless an unassigned neighbour has a smaller (measure, id);
    neighbours of those that joined become assigned.  Assigned nodes leave with their edges, so each round reads less than the
    one before.  both_ways: an edge joins its nodes in both directions, and may be there twice.
    """
    if max_steps == 0:
        raise ValueError("the number of rounds is positive, or negative for as many as needed")
    state = materialize(state, "state")
    done, active, step = [state.where("assigned")], state.where("not assigned").select("i", "m", "cf"), 0
    edges = _between(edges.select("i", "j"), active)
    while (max_steps < 0 or step < max_steps) and not active.isEmpty():
        key = active.select("i", F.struct("m", F.col("i").alias("id")).alias("key"))
        around = edges.join(key.withColumnRenamed("i", "j"), "j").select("i", "key")
        if both_ways:
            around = around.unionByName(edges.join(key, "i").select(F.col("j").alias("i"), "key"))
        least = around.groupBy("i").agg(F.min("key").alias("least"))
        won = active.join(least, "i", "left").where(F.col("least").isNull() | (F.struct("m", F.col("i").alias("id")) < F.col("least")))
        won = materialize(won.select("i", "m", F.lit(True).alias("assigned"), F.lit(F_POINT).alias("cf")), "joins")
        beside = edges.join(won, "i", "left_semi").select(F.col("j").alias("i"))
        if both_ways:
            beside = beside.unionByName(edges.join(won.select(F.col("i").alias("j")), "j", "left_semi").select("i"))
        rest = materialize(active.join(won, "i", "left_anti").join(beside.distinct().withColumn("near", F.lit(True)), "i", "left"), "state")
        done += [won, rest.where("near").select("i", "m", F.lit(True).alias("assigned"), "cf")]
        active, step = rest.where("near is null").select("i", "m", "cf"), step + 1
        edges = _between(edges, active)
    return reduce(DataFrame.unionByName, [*done, active.select("i", "m", F.lit(False).alias("assigned"), "cf")])


def _between(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with both ends in `active`."""
    own = active.select("i")
    return materialize(edges.join(own, "i", "left_semi").join(own.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j"), "edges")


def pmisr(pattern: DataFrame, rows: DataFrame, max_steps: int = -1, pmis: bool = False, zero_measure_c_point: bool = False) -> DataFrame:
    """(i, cf) of the independent set over strong neighbours.

    The measure is the number of strong neighbours and a random part from the id, compared as integers.  PMISR takes
    the smallest measures as F; PMIS the largest as C.  Nodes without strong neighbours are F, or C if `zero_measure_c_point`.
    """
    degree = pattern.groupBy("i").agg(F.count("*").alias("n"))
    measured = rows.select("i").join(degree, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    size = F.col("n") * TWO_32 + random_int(F.col("i"))
    alone = F.lit(C_POINT if zero_measure_c_point else F_POINT) * (-1 if pmis else 1)  # before PMIS negates all
    state = measured.select("i", (-size if pmis else size).alias("m"), (F.col("n") == 0).alias("assigned"), F.when(F.col("n") == 0, alone).otherwise(0).alias("cf"))
    done = rounds(pattern, state, max_steps).select("i", F.when(F.col("cf") == 0, C_POINT).otherwise(F.col("cf")).alias("cf"))
    return done.select("i", (-F.col("cf") if pmis else F.col("cf")).alias("cf"))


def pmisr_on_sum(a: DataFrame, measures: DataFrame, max_steps: int = -1) -> DataFrame:
    """(i, cf) over the pattern of a + a', which is not formed as a matrix; measures: (i, m), with m null for nodes that are C beforehand."""
    off = a.where("i <> j").select("i", "j")
    state = measures.select("i", F.coalesce("m", F.lit(float("inf"))).alias("m"), F.col("m").isNull().alias("assigned"), F.when(F.col("m").isNull(), C_POINT).otherwise(0).alias("cf"))
    return rounds(off, state, max_steps, both_ways=True).select("i", F.when(F.col("cf") == 0, C_POINT).otherwise(F.col("cf")).alias("cf"))
