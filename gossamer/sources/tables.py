"""Matrices and vectors made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.session import read_table


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of part sizes."""
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"))


def part_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splitting by size: large parts are C."""
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.when(F.col("p_size") > 25, 1).otherwise(-1).alias("cf"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the next part of its order, weighted by quantity: a general asymmetric matrix with some 30 entries a row at any scale."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = read_table(spark, sf_dir, "lineitem")
    hops = lines.select(F.col("l_partkey").alias("i"), F.lead("l_partkey").over(order).alias("j"), F.col("l_quantity").alias("q"))
    return hops.where("j is not null").groupBy("i", "j").agg(F.sum("q").alias("v"))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonally dominant: minus the flow off the diagonal, and 1 plus the row's sum on it."""
    off = flow(spark, sf_dir).where("i <> j")
    sums = part_rows(spark, sf_dir).join(off.groupBy("i").agg(F.sum("v").alias("s")), "i", "left")
    return off.select("i", "j", (-F.col("v")).alias("v")).unionByName(sums.select("i", F.col("i").alias("j"), (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("v")))
