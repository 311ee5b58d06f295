"""Strength of connection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gossamer.operators.algebra import remove_small, transpose, union_pattern


def strength(a: DataFrame, threshold: float, symmetrize: bool = True, square: bool = False, diagonal_relative: bool = False) -> DataFrame:
    """Pattern (i, j), i <> j, with abs(a_ij) >= threshold times the row's largest off the diagonal (or its diagonal).

    square: distance two, S'S + S without the diagonal; symmetrize: S + S'.
    """
    s = remove_small(a, threshold, relative=-1, drop_diagonal=-1, diagonal_strength=diagonal_relative).select("i", "j")
    if square:
        second = s.join(s.withColumnRenamed("j", "c"), "i").selectExpr("j as i", "c as j").where("i <> j")
        s = union_pattern(second, s)  # repeated places go here, in one exchange
    if symmetrize:
        s = union_pattern(s, transpose(s))
    return s
