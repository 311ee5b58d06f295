"""Randoms that depend on the row's id alone, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4_294_967_296


def random_int(i: Column, salt: str = "") -> Column:
    """32 bits of the MD5 of the id as text and a salt, as a long."""
    text = i.cast("string") if not salt else F.concat(i.cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(i: Column, salt: str = "") -> Column:
    """Uniform in [0, 1)."""
    return random_int(i, salt) / F.lit(float(TWO_32))


def gaussian(i: Column, salt: str = "") -> Column:
    """Standard normal by Box-Muller."""
    first = (random_int(i, salt + "a") + 1) / F.lit(float(TWO_32 + 1))
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * F.pi() * uniform(i, salt + "b"))
