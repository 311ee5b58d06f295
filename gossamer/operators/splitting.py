"""Coarse/fine splittings and the diagonally dominant submatrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.randoms import uniform
from gossamer.operators import algebra as al
from gossamer.operators.blocked import Stored
from gossamer.operators.luby import pmisr, pmisr_on_sum
from gossamer.operators.ordered import WIDTH, first_of_all
from gossamer.operators.strength import strength
from gossamer.plans.model import C_POINT, F_POINT, InverseOptions, InverseType, SplittingType
from gossamer.session import materialize

#: Fixed values of compatible relaxation: sweeps with a diagonal and with a polynomial inverse, polynomial order, candidates' least part, passes.
CR_SWEEPS, CR_SWEEPS_POLY, CR_POLY_ORDER, CR_CANDIDATE, CR_PASSES = 10, 1, 6, 0.1, 100
BINS = 1000


def fine_set(cf: DataFrame) -> DataFrame:
    return cf.where(F.col("cf") == F_POINT).select("i")


def coarse_set(cf: DataFrame) -> DataFrame:
    return cf.where(F.col("cf") == C_POINT).select("i")


def ratio_bins(ratios: DataFrame) -> DataFrame:
    """(bin, n, above): rows in each of 1000 bins of the dominance ratio, the last open, and rows in that bin and those above it."""
    bins = ratios.select(F.least(F.floor(F.col("ratio") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.withColumn("above", F.sum("n").over(Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)))  # at most 1000 rows


def swap_bound(ratios: DataFrame, fraction: float, least: int = 0) -> DataFrame:
    """One row (bound): rows with a ratio of at least the bound are swapped; null if none are."""
    if fraction < 0:
        return ratios.sparkSession.range(1).select(F.lit(-float(fraction)).alias("bound"))
    wanted = ratios.agg(F.floor(F.count("*") * F.lit(float(fraction))).alias("wanted")).select(F.greatest("wanted", F.lit(least)).alias("wanted"))
    # With no bin that reaches it (never for a fraction up to 1) nothing is swapped.
    return ratio_bins(ratios).crossJoin(wanted).where("wanted > 0 and above >= wanted").agg((F.max("bin") / F.lit(float(BINS))).alias("bound"))  # one row of totals


def ddc(a: DataFrame, cf: DataFrame, fraction: float) -> DataFrame:
    """Markers after the worst F rows went to C.

    fraction > 0: those in the bins, from the worst, that hold that part of the F rows; < 0: those with a ratio of at least -fraction;
    a ratio of 0 never goes; 0 changes nothing.
    """
    if fraction == 0:
        return cf
    ratios = al.dominance(a, fine_set(cf))
    swapped = ratios.join(F.broadcast(swap_bound(ratios, fraction)), F.col("ratio") >= F.col("bound")).where("ratio <> 0").select("i", F.lit(True).alias("swap"))
    return cf.join(swapped, "i", "left").select("i", F.when(F.col("swap"), F.lit(C_POINT)).otherwise(F.col("cf")).alias("cf"))


def diag_dom(a: DataFrame, cf: DataFrame, threshold: float) -> DataFrame:
    """Repeats until every F row's ratio is below the threshold: an independent set of the worst rows goes to C."""
    while True:
        ratios = materialize(al.dominance(a, fine_set(cf)), "ratios")
        worst = ratios.agg(F.max("ratio")).first()[0]
        if worst is None or worst < threshold:
            return cf
        base = max(10.0, 2 * worst)
        measures = ratios.select("i", F.when(F.col("ratio") >= threshold, base - (F.col("ratio") - uniform(F.col("i"), "dd") * 1e-10)).alias("m"))
        chosen = pmisr_on_sum(al.submatrix(a, ratios, ratios), measures).where(F.col("cf") == F_POINT).select("i", F.lit(True).alias("swap"))
        cf = materialize(cf.join(chosen, "i", "left").select("i", F.when(F.col("swap"), F.lit(C_POINT)).otherwise(F.col("cf")).alias("cf")), "markers")


def aggregate(pattern: DataFrame, rows: DataFrame, boundary: DataFrame | None = None, width: int = WIDTH, counted: list[str] | None = None) -> DataFrame:
    """(i, cf, aggregate): the sequential three-step aggregation; an aggregate's id is its root, rows without neighbours are F and have none (null).

    pattern is symmetric.  The steps are those of a pass over the rows in order, run as rounds over all rows at once: a row is a
    root if it and its neighbours meet no earlier root or a root's neighbour; then rows beside covered ones follow the first of these; what is left
    makes roots of its own, which take their later neighbours.  boundary: (i, cf) fixed beforehand.  width, counted: as in `ordered`.
    """
    edges = materialize(pattern.select("i", "j"), "edges")
    nodes = materialize(rows.select("i"), "rows")
    alone = nodes.join(edges, "i", "left_anti").select("i", F.lit(F_POINT).alias("cf"), F.lit(None).cast("long").alias("aggregate"))
    free = nodes.join(edges, "i", "left_semi")
    fixed = free.limit(0).select("i", F.lit(0).alias("cf")) if boundary is None else materialize(boundary.join(free, "i", "left_semi").where("cf <> 0").select("i", F.col("cf").cast("int").alias("cf")), "fixed")
    free = free.join(fixed, "i", "left_anti")
    beside_fixed = edges.join(fixed.select(F.col("i").alias("j")), "j", "left_semi").select("i").distinct()
    may = free.join(beside_fixed, "i", "left_anti")
    closed = edges.select("i", F.col("j").alias("k")).unionByName(nodes.select("i", F.col("i").alias("k")))
    roots = materialize(first_of_all(closed.join(may, "i", "left_semi"), width, counted), "roots")
    covered = roots.select("i", F.lit(C_POINT).alias("cf"), F.col("i").alias("aggregate")).unionByName(edges.join(roots, "i", "left_semi").select(F.col("j").alias("i"), F.lit(F_POINT).alias("cf"), F.col("i").alias("aggregate")))
    covered = materialize(covered, "covered")
    rest = free.join(covered, "i", "left_anti")
    near = edges.join(rest, "i", "left_semi").join(covered.select(F.col("i").alias("j"), "aggregate"), "j").groupBy("i").agg(F.min_by("aggregate", "j").alias("aggregate"))
    follow = materialize(near.select("i", F.lit(F_POINT).alias("cf"), "aggregate"), "follow")
    left = materialize(rest.join(follow, "i", "left_anti"), "left")
    between = materialize(edges.join(left, "i", "left_semi").join(left.select(F.col("i").alias("j")), "j", "left_semi"), "between")
    # A remnant root shuts out its neighbours alone: its places are its edges, each by its two ends.
    ends = between.select("i", F.concat_ws(",", F.least("i", "j"), F.greatest("i", "j")).alias("k")).unionByName(left.select("i", F.concat_ws(",", "i", "i").alias("k")))
    remnants = materialize(first_of_all(ends, width, counted), "remnants")
    taken = between.join(remnants, "i", "left_semi").groupBy(F.col("j").alias("i")).agg(F.min("i").alias("aggregate"))
    parts = [
        alone, covered, follow, fixed.select("i", "cf", F.lit(None).cast("long").alias("aggregate")),
        remnants.select("i", F.lit(C_POINT).alias("cf"), F.col("i").alias("aggregate")), taken.select("i", F.lit(F_POINT).alias("cf"), "aggregate"),
    ]
    return reduce(DataFrame.unionByName, parts)


def local_aggregate(pattern: DataFrame, rows: DataFrame, block_rows: int | None, max_luby_steps: int = -1, pmis_boundary: bool = False) -> DataFrame:
    """(i, cf, aggregate): aggregation within blocks of `block_rows` consecutive ids (None: one block), blind to neighbours in others.

    pmis_boundary: rows with neighbours in other blocks first get their markers from PMIS over the whole pattern, and keep them.
    """
    if block_rows is None:
        return aggregate(pattern, rows)
    block = lambda c: F.floor(F.col(c) / block_rows)
    if not pmis_boundary:
        return aggregate(pattern.where(block("i") == block("j")), rows)
    pattern = materialize(pattern.select("i", "j"), "strong")  # read by the independent set, the boundary and the blocks
    inner = pattern.where(block("i") == block("j"))
    edge = pattern.where(block("i") != block("j")).select("i").distinct()
    # Written first: a semi join goes through a union, so a task would join and sort the boundary once for every round's table.
    cf = materialize(pmisr(pattern, rows, max_luby_steps, pmis=True), "markers")
    markers = materialize(cf.join(edge, "i", "left_semi"), "boundary")
    found = aggregate(inner, rows, markers)
    # A row without neighbours in its block that lies on the boundary keeps its marker.
    return found.join(markers.withColumnRenamed("cf", "was"), "i", "left").select("i", F.coalesce("was", "cf").alias("cf"), "aggregate")


def cr_pass(a: DataFrame, cf: DataFrame, target: float, inverse: InverseOptions) -> tuple[DataFrame, float, int]:
    """(markers, rate, number swapped) of one pass of compatible relaxation."""
    from gossamer.operators.inverse import ApproxInverse, jacobi

    fine = materialize(fine_set(cf), "fine")
    n = fine.count()
    if not n:
        return cf, 0.0, 0
    aff = materialize(al.submatrix(a, fine, fine), "aff")
    held = Stored(aff, often=True)  # sweeps move vectors alone
    diagonal = al.diagonal(aff, fine)
    poly = inverse.type not in (InverseType.WJACOBI, InverseType.JACOBI) and n > inverse.poly_order + 1
    forced = diagonal.where("x = 0").select("i", F.lit(True).alias("forced")) if not poly else None
    if poly:
        m = ApproxInverse.build(aff, fine, inverse).matrix
        sweeps, times = CR_SWEEPS_POLY, lambda x: al.spmv(m, x)
    else:
        d = materialize(jacobi(aff, fine, weighted=inverse.type != InverseType.JACOBI, zero_diagonals=True).select("i", F.col("v").alias("d")), "jacobi")
        sweeps, times = CR_SWEEPS, lambda x: x.join(d, "i").select("i", (F.col("x") * F.col("d")).alias("x"))
    e = materialize(fine.select("i", uniform(F.col("i"), "cr").alias("x")), "error")
    before = al.norm2(e)
    for _ in range(sweeps):
        e = materialize(al.combine(e, (-1.0, times(al.spmv(held, e)))), "error")
    got = al.norms(e).first()
    rate = (got.two / before) ** (1 / sweeps) if before else 0.0
    if rate <= target:
        return cf, rate, 0
    part = F.abs("x") / F.lit(got.inf) if got.inf else F.lit(0.0)
    rated = e.select("i", part.alias("part"))
    if forced is not None:
        rated = rated.join(forced, "i", "left").select("i", F.when(F.col("forced"), 2.0).otherwise(F.col("part")).alias("part"))
    measures = rated.select("i", F.when(F.col("part") >= CR_CANDIDATE, 10.0 - (F.col("part") - uniform(F.col("i"), "cr") / 1e10)).alias("m"))
    chosen = materialize(pmisr_on_sum(aff, measures).where(F.col("cf") == F_POINT).select("i", F.lit(True).alias("swap")), "chosen")
    swapped = cf.join(chosen, "i", "left").select("i", F.when(F.col("swap"), F.lit(C_POINT)).otherwise(F.col("cf")).alias("cf"))
    return materialize(swapped, "markers"), rate, chosen.count()


def compute_cf_splitting(
    a: DataFrame, rows: DataFrame, symmetric: bool = False, strong_threshold: float = 0.5, max_luby_steps: int = -1, splitting: SplittingType = SplittingType.PMISR_DDC,
    ddc_its: int = 1, fraction: float = 0.1, cr_inverse: InverseOptions | None = None, block_rows: int | None = None,
) -> DataFrame:
    """(i, cf) of one of the seven splittings; block_rows: the blocks that aggregations are local to."""
    if splitting == SplittingType.CR:
        cf = rows.select("i", F.lit(F_POINT).alias("cf"))
        for _ in range(CR_PASSES):
            cf, rate, swapped = cr_pass(a, cf, strong_threshold, cr_inverse or InverseOptions(poly_order=CR_POLY_ORDER))
            if rate <= strong_threshold or not swapped:
                break
        return cf
    square = splitting == SplittingType.PMIS_DIST2
    wants_sum = splitting != SplittingType.PMIS_DIST2 and not (symmetric and splitting in (SplittingType.PMISR_DDC, SplittingType.DIAG_DOM))
    s = strength(a, strong_threshold, symmetrize=wants_sum, square=square)
    if splitting not in (SplittingType.AGG, SplittingType.PMIS_AGG):
        s = materialize(s, "strong")  # the degrees and the rounds read it
    if splitting in (SplittingType.AGG, SplittingType.PMIS_AGG):
        return local_aggregate(s, rows, block_rows, max_luby_steps, splitting == SplittingType.PMIS_AGG).select("i", "cf")
    pmis = splitting in (SplittingType.PMIS, SplittingType.PMIS_DIST2)
    cf = materialize(pmisr(s, rows, max_luby_steps, pmis=pmis), "markers")
    if strong_threshold != 0 and splitting == SplittingType.PMISR_DDC:
        for _ in range(ddc_its):
            cf = materialize(ddc(a, cf, fraction), "markers")
    if strong_threshold != 0 and splitting == SplittingType.DIAG_DOM:
        cf = diag_dom(a, cf, strong_threshold)
    return cf


def diag_dom_submatrix(a: DataFrame, rows: DataFrame, max_dd_ratio: float) -> tuple[DataFrame, DataFrame]:
    """(a(F, F), F) where every row's dominance ratio is below the bound in (0, 1)."""
    if not 0 < max_dd_ratio < 1:
        raise ValueError("the bound is between 0 and 1")
    fine = fine_set(compute_cf_splitting(a, rows, strong_threshold=max_dd_ratio, splitting=SplittingType.DIAG_DOM))
    return al.submatrix(a, fine, fine), fine
