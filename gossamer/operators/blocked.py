"""Matrices that stay where they are: rows in stored blocks, and for each block the list of columns whose values it needs.

`Blocked` writes a matrix once as a table bucketed by block, with the distinct
columns of each block in a second one bucketed by column.  A product then moves
the vector to the lists and the listed values to the blocks; the matrix is
read bucket by bucket and never shuffled.  With blocks of consecutive rows a
matrix of neighbours needs few values from outside (`halo`).

`Stored` is for matrices that may be used once or often: its first product is
a plain join, its second writes the blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.session import fresh, prepare

#: Entries of a block, about, until there are MOST of them; of smaller ones where there would be fewer than cores.
BLOCK_ENTRIES, SMALL_ENTRIES, MOST = 1_000_000, 100_000, 50_000


def block_of(i: Column, width: int) -> Column:
    """Blocks are of `width` consecutive ids."""
    return F.floor(i / width).cast("long")


def _product(entries: pa.Table, values: pa.Table) -> pa.Table:
    """Sums of a block's rows over the columns that have values; rows with none are absent."""
    i, j, v = (entries.column(c).to_numpy() for c in ("i", "j", "v"))
    known, x = values.column("j").to_numpy(), values.column("x").to_numpy()
    if not len(i) or not len(known):
        return pa.table({"i": pa.array([], pa.int64()), "x": pa.array([], pa.float64())})
    order = np.argsort(known, kind="stable")
    known, x = known[order], x[order]
    at = np.minimum(np.searchsorted(known, j), len(known) - 1)
    here = known[at] == j
    rows, row = np.unique(i[here], return_inverse=True)
    return pa.table({"i": rows, "x": np.bincount(row, v[here] * x[at[here]], len(rows))})


class Blocked:
    """(i, j, v) in buckets of row blocks; `times` is a product without an exchange of the matrix."""

    def __init__(self, a: DataFrame, blocks: int | None = None):
        spark = self.spark = prepare(a.sparkSession)
        got = a.agg(F.count("*").alias("n"), F.max("i").alias("last")).first()
        wanted = max(-(-got.n // BLOCK_ENTRIES), min(-(-got.n // SMALL_ENTRIES), spark.sparkContext.defaultParallelism))
        self.blocks = blocks or max(1, min((got.last or 0) + 1, wanted, MOST))
        self.width = -(-((got.last or 0) + 1) // self.blocks)
        dealt = a.select(block_of(F.col("i"), self.width).alias("block"), "i", "j", "v")
        self.entries = self._save(dealt, "block", "blocks")
        self.needed = self._save(self.entries.select("block", "j").distinct(), "j", "needed")

    def _save(self, df: DataFrame, key: str, tag: str) -> DataFrame:
        name = f"{tag}_{uuid.uuid4().hex}"
        df.repartition(self.blocks, key).write.option("path", fresh(self.spark, tag)).bucketBy(self.blocks, key).saveAsTable(name)
        return self.spark.table(name)

    def halo(self) -> DataFrame:
        """(block, j): columns of each block whose rows lie in another."""
        return self.needed.where(block_of(F.col("j"), self.width) != F.col("block"))

    def values(self, x: DataFrame) -> DataFrame:
        """(block, j, x): the values that each block needs."""
        return self.needed.join(x.select(F.col("i").alias("j"), "x"), "j").select("block", "j", "x")

    def times(self, x: DataFrame) -> DataFrame:
        """The product with x; rows without entries are absent."""
        moved = self.values(x).repartition(self.blocks, "block")
        return self.entries.groupBy("block").cogroup(moved.groupBy("block")).applyInArrow(_product, "i long, x double")


class Stored:
    """A matrix that is written as blocks when it is used a second time, or (often) at once."""

    def __init__(self, a: DataFrame, often: bool = False):
        self.a, self.uses = a, int(often)
        self.blocked: Blocked | None = None

    def times(self, x: DataFrame) -> DataFrame:
        from gossamer.operators.algebra import spmv

        self.uses += 1
        if self.uses == 1:
            return spmv(self.a, x)
        self.blocked = self.blocked or Blocked(self.a)
        return self.blocked.times(x)
