"""Graph partitions, and how many partitions a level deserves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.randoms import uniform
from gossamer.operators.algebra import renumber, transpose, union_pattern
from gossamer.session import materialize


def partition_graph(a: DataFrame, rows: DataFrame, parts: int, rounds: int = 4) -> DataFrame:
    """(i, part): parts of nearly equal size with few edges of a + a' between them.

    Starts from blocks of consecutive ids.  In each round a row wants the part that most of its neighbours are in; of those that
    want from p to q as many go as want from q to p, chosen by a hash of their ids, so sizes stay the same on average and no
    task ranks the rows of a part.
    """
    edges = materialize(union_pattern(a, transpose(a)).where("i <> j"), "edges")
    numbered = materialize(renumber(rows), "numbered")
    n = numbered.count()
    where = materialize(numbered.select("i", F.floor(F.col("k") * parts / max(1, n)).cast("int").alias("part")), "parts")
    for k in range(rounds):
        beside = edges.join(where.select(F.col("i").alias("j"), F.col("part").alias("to")), "j").groupBy("i", "to").agg(F.count("*").alias("n"))
        best = beside.groupBy("i").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"), F.max("n").alias("most"))
        own = beside.withColumnRenamed("to", "part").withColumnRenamed("n", "have")
        wants = where.join(best, "i").join(own, ["i", "part"], "left").where("to <> part and most > coalesce(have, 0)").select("i", "part", "to")
        wants = materialize(wants, "wants")
        flows = wants.groupBy("part", "to").agg(F.count("*").alias("n"))
        back = flows.select(F.col("to").alias("part"), F.col("part").alias("to"), F.col("n").alias("back"))
        share = flows.join(back, ["part", "to"]).select("part", "to", (F.least("n", "back") / F.col("n")).alias("share"))
        go = wants.join(share, ["part", "to"]).where(uniform(F.col("i"), f"go{k}") < F.col("share")).select("i", F.col("to").alias("next"))
        where = materialize(where.join(go, "i", "left").select("i", F.coalesce("next", "part").alias("part")), "parts")
    return where


def edge_cut(a: DataFrame, where: DataFrame) -> int:
    """Entries between rows of different parts."""
    return a.join(where, "i").join(where.select(F.col("i").alias("j"), F.col("part").alias("other")), "j").where("part <> other").count()


def repartition(a: DataFrame, where: DataFrame, parts: int) -> DataFrame:
    """a with the rows of a part in one partition."""
    return a.join(where, "i").repartition(parts, "part").drop("part")


def active_parts(parts: int, n_rows: int, ratio: float | None, row_limit: int = 50, least_ratio: float = 2.0, factor: int = 2) -> int:
    """Partitions that a level keeps: fewer by the factor if rows are few or the local entries too few against the remote ones, and
    by more while rows stay below the limit for each."""
    few = parts > 1 and n_rows < row_limit * parts
    if not (few or (ratio and ratio <= least_ratio)):
        return parts
    stride, left = factor, parts
    while left > 1 and n_rows < row_limit * left:
        stride *= factor
        left = max(1, parts // stride)
    return max(1, parts // stride)
