"""Reduction multigrid: setup of the level hierarchy, its cycle, statistics and reuse."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.operators import algebra as al
from gossamer.operators import transfer as tr
from gossamer.operators.blocked import Stored
from gossamer.operators.inverse import ApproxInverse
from gossamer.operators.krylov_basis import start_vector
from gossamer.operators.partition import active_parts
from gossamer.operators.splitting import coarse_set, compute_cf_splitting, fine_set
from gossamer.plans.model import InverseType, Options, SplittingType, Timers, ZType
from gossamer.session import materialize


@dataclass
class Level:
    """One level: its matrix, splitting, blocks, inverses and transfer operators."""

    a: DataFrame
    rows: DataFrame
    n: int
    nnz: int
    cf: DataFrame | None = None
    aff: DataFrame | None = None
    afc: DataFrame | None = None
    acf: DataFrame | None = None
    acc: DataFrame | None = None
    inv_ff: ApproxInverse | None = None
    inv_cc: ApproxInverse | None = None
    inv_full: ApproxInverse | None = None
    z: DataFrame | None = None
    w: DataFrame | None = None
    r: DataFrame | None = None
    p: DataFrame | None = None
    groups: list[tuple[str, int]] = field(default_factory=list)
    n_fine: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    stored: dict[str, Stored] = field(default_factory=dict)

    def times(self, name: str, x: DataFrame) -> DataFrame:
        """The product of one of the level's matrices, which stays where it is from the second product on."""
        self.stored[name] = self.stored.get(name) or Stored(getattr(self, name))
        return al.spmv(self.stored[name], x)


def fingerprint(a: DataFrame) -> tuple[int, int]:
    """Number of entries and an order-free hash of the pattern."""
    got = a.agg(F.count("*").alias("n"), F.sum(F.xxhash64("i", "j").cast("decimal(38,0)")).alias("h")).first()
    return got.n, int(got.h or 0)


class Hierarchy:
    """Levels built by `build`; `apply` is one cycle as a preconditioner."""

    def __init__(self, options: Options):
        self.options, self.levels, self.timers = options, [], Timers()
        self.coarse: ApproxInverse | None = None
        self.print: tuple[int, int] | None = None
        self.frozen = False

    # --- setup

    @classmethod
    def build(cls, a: DataFrame, rows: DataFrame, options: Options = Options(), left: DataFrame | None = None, right: DataFrame | None = None) -> Hierarchy:
        """left, right: near-nullspace vectors (i, xs) for the constraints; constants by default."""
        out = cls(options)
        with out.timers.timed("setup"):
            out._setup(a, rows, left, right, None)
        return out

    def rebuild(self, a: DataFrame, rows: DataFrame, options: Options | None = None) -> Hierarchy:
        """For the next system.  Frozen: unchanged.  Another pattern or other options: built anew.

        The same pattern with reuse_sparsity keeps, by amount, the splittings (1), the patterns of Z and W too (2) and those
        of the coarse matrices too (3); with reuse_poly_coeffs the polynomials' coefficients.
        """
        if self.frozen:
            return self
        options = options or self.options
        same = options == self.options and fingerprint(a) == self.print
        out = Hierarchy(options)
        with out.timers.timed("setup"):
            out._setup(a, rows, None, None, self if same and (options.reuse_sparsity or options.reuse_poly_coeffs) else None)
        return out

    def _setup(self, a: DataFrame, rows: DataFrame, left: DataFrame | None, right: DataFrame | None, old: Hierarchy | None) -> None:
        o = self.options
        a, rows = materialize(a.select("i", "j", "v"), "level"), materialize(rows.select("i"), "rows")
        self.print = fingerprint(a)
        left = left if left is not None else tr.constant_vector(rows)
        right = right if right is not None else tr.constant_vector(rows)
        while True:
            level = Level(a, rows, rows.count(), a.count())
            k = len(self.levels)
            self.levels.append(level)
            before = old.levels[k] if old and k < len(old.levels) else None
            coefficients = (old.coarse.coefficients if old and o.reuse_poly_coeffs and k == len(old.levels) - 1 else None) if old else None
            if k + 1 >= o.max_levels or self._truncates(level, k):
                break
            with self.timers.timed("coarsen"):
                keep = before is not None and before.cf is not None and o.reuse_sparsity and o.reuse_amount >= 1
                level.cf = before.cf if keep else materialize(self._split(a, rows), "markers")
            fine, coarse = materialize(fine_set(level.cf), "fine"), materialize(coarse_set(level.cf), "coarse")
            level.n_fine, n_coarse = fine.count(), coarse.count()
            if not (n_coarse > o.coarse_eq_limit and level.n_fine):
                level.cf = None
                break
            self._blocks(level, fine, coarse, before)
            self._transfer(level, fine, coarse, left, right, before)
            with self.timers.timed("rap"):
                pattern = before is not None and o.reuse_sparsity and o.reuse_amount >= 3 and k + 1 < len(old.levels)
                whole = pattern or o.a_lump  # otherwise small entries are dropped where rows are made, and the matrix is written once
                a = tr.coarse_matrix(level.a, level.r, level.p, o.symmetric, 0.0 if whole else o.a_drop, False, None)
                a = materialize(a, "full") if whole else a
            with self.timers.timed("drop"):
                if whole:
                    a = al.restrict(a, old.levels[k + 1].a, o.a_lump) if pattern else al.remove_small(a, o.a_drop, relative=1, lump=o.a_lump)
                if o.processor_agglom:
                    with self.timers.timed("proc agglom"):
                        a = self._agglomerated(a, n_coarse) if whole else a
                a = materialize(a, "level")
            rows = coarse
            left, right = left.join(rows, "i", "left_semi"), right.join(rows, "i", "left_semi")
        if self.coarse is None:
            with self.timers.timed("inverse"):
                self.coarse = ApproxInverse.build(self.levels[-1].a, self.levels[-1].rows, o.coarsest_inverse(), coefficients)

    def _split(self, a: DataFrame, rows: DataFrame) -> DataFrame:
        o = self.options
        return compute_cf_splitting(a, rows, o.symmetric, o.strong_threshold, o.max_luby_steps, SplittingType(o.cf_splitting_type), o.ddc_its, o.ddc_fraction, o.inverse() if o.cf_splitting_type == SplittingType.CR else None)

    def _agglomerated(self, a: DataFrame, n_rows: int) -> DataFrame:
        """Small levels in fewer partitions.  Entries are dealt by a hash of their row, so their locality is the same on every level and has no say."""
        o, parts = self.options, a.sparkSession.sparkContext.defaultParallelism
        active = active_parts(parts, n_rows, None, o.process_eq_limit, o.processor_agglom_ratio, o.processor_agglom_factor)
        return a.coalesce(active) if active < parts else a

    def _truncates(self, level: Level, k: int) -> bool:
        """Whether the coarsest-grid solver is good enough here: norm(a q(a) b - b) < tolerance norm(b) for a random b."""
        o = self.options
        if o.auto_truncate_start_level < 0 or k < o.auto_truncate_start_level:
            return False
        with self.timers.timed("truncate"):
            m = ApproxInverse.build(level.a, level.rows, o.coarsest_inverse())
            b = materialize(start_vector(level.rows, "truncate"), "vector")
            miss = al.norm2(al.combine(b, (-1.0, al.spmv(level.a, m.apply(b)))))
        if miss < o.auto_truncate_tol * al.norm2(b):
            self.coarse = m
            return True
        return False

    def _blocks(self, level: Level, fine: DataFrame, coarse: DataFrame, before: Level | None) -> None:
        o = self.options
        with self.timers.timed("extract"):
            marked = materialize(al.split_blocks(level.a, level.cf), "blocks")
        block = lambda r, c: marked.where((F.col("cf_i") == r) & (F.col("cf_j") == c)).select("i", "j", "v")
        level.aff, level.afc, level.acf, level.acc = block(-1, -1), block(-1, 1), block(1, -1), block(1, 1)
        level.groups = o.groups()
        inverse = o.inverse()
        reuse = o.reuse_poly_coeffs and before is not None
        with self.timers.timed("inverse"):
            if al.is_diagonal(level.aff) and inverse.type not in (InverseType.SAI, InverseType.ISAI):
                inverse = replace(inverse, sparsity_order=0)
                if inverse.type != InverseType.WJACOBI and inverse.poly_order > 2:
                    level.groups = [(kind, 1 if kind == "f" else n) for kind, n in level.groups]
            level.inv_ff = ApproxInverse.build(level.aff, fine, inverse, before.inv_ff.coefficients if reuse and before.inv_ff else None)
            if any(kind == "c" for kind, _ in level.groups):
                level.inv_cc = ApproxInverse.build(level.acc, coarse, o.c_inverse(), before.inv_cc.coefficients if reuse and before.inv_cc else None)
            if o.full_smoothing_up_and_down:
                level.inv_full = ApproxInverse.build(level.a, level.rows, o.inverse())

    def _transfer(self, level: Level, fine: DataFrame, coarse: DataFrame, left: DataFrame, right: DataFrame, before: Level | None) -> None:
        o = self.options
        aff, afc, acf = level.aff, level.afc, level.acf
        if o.strong_r_threshold:
            strong = al.split_blocks(materialize(al.remove_small(level.a, o.strong_r_threshold, relative=1), "strong"), level.cf)
            block = lambda r, c: strong.where((F.col("cf_i") == r) & (F.col("cf_j") == c)).select("i", "j", "v")
            aff, afc, acf = block(-1, -1), block(-1, 1), block(1, -1)
        keep = before is not None and o.reuse_sparsity and o.reuse_amount >= 2
        needs = o.z_type == ZType.PRODUCT or not o.one_point_classical_prolong or o.improve_w_its or o.improve_z_its
        m = None
        if needs:
            m = level.inv_ff.matrix if level.inv_ff.matrix is not None and not o.strong_r_threshold else ApproxInverse.build(aff, fine, replace(level.inv_ff.options, matrix_free=False), level.inv_ff.coefficients).matrix
        drop = lambda make, old: al.restrict(make(0.0), old) if keep and old is not None else make(o.r_drop)
        d = al.diagonal(m, fine) if (o.improve_w_its or o.improve_z_its) else None
        with self.timers.timed("restrict"):
            self._restriction(level, fine, coarse, left, before, acf, m, d, drop)
        if o.symmetric:
            with self.timers.timed("prolong"):
                level.p = al.transpose(level.r)
            return
        with self.timers.timed("prolong"):
            self._prolongation(level, fine, coarse, right, before, afc, m, d, drop)

    def _restriction(self, level: Level, fine: DataFrame, coarse: DataFrame, left: DataFrame, before: Level | None, acf: DataFrame, m: DataFrame | None, d: DataFrame | None, drop) -> None:
        o = self.options
        if o.z_type == ZType.PRODUCT:
            z = lambda least: tr.ideal_z(acf, m, least)
        else:
            z = lambda least: al.remove_small(tr.local_z(level.aff, level.acf, o.lair_distance, o.z_type == ZType.LAIR), least, relative=1, drop_diagonal=1)
        z = materialize(drop(z, before.z if before else None), "z")
        for _ in range(o.improve_z_its):
            z = materialize(tr.improve_z(z, level.aff, level.acf, d), "z")
        if o.constrain_z:
            with self.timers.timed("constrain"):
                smooth = self._smoothed(level, left, True)
                # By way of the transpose: Z' takes the left vectors on C to those on F.
                z = al.transpose(tr.constrain(al.transpose(z), smooth.join(coarse, "i", "left_semi"), smooth.join(fine, "i", "left_semi")))
                z = materialize(z.select("i", "j", "v"), "z")
        with self.timers.timed("identity"):
            level.z, level.r = z, materialize(tr.restrictor(z, coarse), "r")

    def _prolongation(self, level: Level, fine: DataFrame, coarse: DataFrame, right: DataFrame, before: Level | None, afc: DataFrame, m: DataFrame | None, d: DataFrame | None, drop) -> None:
        o = self.options
        if o.one_point_classical_prolong:
            w = tr.one_point(afc)
        else:
            w = drop(lambda least: tr.ideal_w(m, afc, least), before.w if before else None)
        w = materialize(w, "w")
        for _ in range(o.improve_w_its):
            w = materialize(tr.improve_w(w, level.aff, level.afc, d), "w")
        if o.constrain_w:
            with self.timers.timed("constrain"):
                smooth = self._smoothed(level, right, False)
                w = materialize(tr.constrain(w, smooth.join(coarse, "i", "left_semi"), smooth.join(fine, "i", "left_semi")), "w")
        with self.timers.timed("identity"):
            level.w, level.p = w, materialize(tr.prolongator(w, coarse), "p")

    def _smoothed(self, level: Level, vectors: DataFrame, transposed: bool) -> DataFrame:
        n = vectors.select(F.size("xs").alias("n")).first().n
        out = level.rows.select("i", F.array().cast("array<double>").alias("xs"))
        for k in range(n):
            x = tr.smooth_vector(level.a, vectors.select("i", F.col("xs")[k].alias("x")), transposed)
            out = out.join(x, "i").select("i", F.concat("xs", F.array("x")).alias("xs"))
        return materialize(out, "vectors")

    # --- cycle

    def apply(self, b: DataFrame) -> DataFrame:
        """One cycle from a zero guess: restrict to the coarsest grid, solve there, and smooth on the way up."""
        with self.timers.timed("solve"):
            right, guesses = [materialize(b.select("i", "x"), "rhs")], []
            for level in self.levels[:-1]:
                r = right[-1]
                if level.inv_full is not None:
                    x = materialize(level.inv_full.apply(r), "smooth")
                    guesses.append(x)
                    r = al.combine(r, (-1.0, level.times("a", x)))
                else:
                    guesses.append(None)
                right.append(materialize(al.fill(level.times("r", r), self.levels[len(right)].rows), "rhs"))
            x = materialize(self.coarse.apply(right[-1]), "solution")
            for level, rhs, guess in zip(self.levels[-2::-1], right[-2::-1], guesses[::-1]):
                x = al.fill(level.times("p", x), level.rows)
                if guess is not None:
                    x = al.combine(x, (1.0, guess))
                x = materialize(x, "solution")
                if level.inv_full is not None:
                    x = materialize(al.combine(x, (1.0, level.inv_full.apply(al.combine(rhs, (-1.0, level.times("a", x)))))), "solution")
                    continue
                for kind, times in level.groups:
                    x = smooth(level, rhs, x, kind, times)
        return x

    # --- statistics

    def complexities(self) -> dict[str, float]:
        """Grid, operator, cycle and storage complexity, each over the first level's rows or entries."""
        top = self.levels[0]
        cycle = self.coarse.nnz if self.coarse.matrix is not None else self.coarse.matvecs() * self.levels[-1].nnz
        stored = cycle if self.coarse.matrix is not None else 0
        for level in self.levels[:-1]:
            c = self._counts(level)
            for kind in "fc":
                times, groups = sum(n for k, n in level.groups if k == kind), sum(k == kind for k, _ in level.groups)
                inv, block = (level.inv_ff, "aff") if kind == "f" else (level.inv_cc, "acc")
                if groups:
                    cycle += times * ((inv.nnz if inv.matrix is not None else inv.matvecs() * c[block]) + c[block]) + groups * c["afc" if kind == "f" else "acf"]
            cycle += c["r"] + (c["r"] if self.options.symmetric else c["p"])
            stored += sum(c.values()) + (level.inv_ff.nnz or 0) + ((level.inv_cc.nnz or 0) if level.inv_cc else 0)
        reused = sum(lv.nnz for lv in self.levels[1:]) + sum(self._counts(lv)["r"] + self._counts(lv)["p"] for lv in self.levels[:-1]) if self.options.reuse_sparsity else 0
        return {
            "grid": sum(lv.n for lv in self.levels) / top.n,
            "operator": sum(lv.nnz for lv in self.levels) / max(1, top.nnz),
            "cycle": cycle / max(1, top.nnz),
            "storage": (stored + self.levels[-1].nnz) / max(1, top.nnz),
            "reuse_storage": reused / max(1, top.nnz),
        }

    @staticmethod
    def _counts(level: Level) -> dict[str, int]:
        if not level.counts:
            level.counts = {k: getattr(level, k).count() for k in ("aff", "afc", "acf", "acc", "r", "p")}
        return level.counts

    def stats_df(self) -> DataFrame:
        """A row for each level: level, rows, fine_rows, nnz."""
        return self.levels[0].a.sparkSession.createDataFrame([(k, lv.n, lv.n_fine if lv.cf is not None else 0, lv.nnz) for k, lv in enumerate(self.levels)], "level int, n_rows long, fine_rows long, nnz long")


def smooth(level: Level, b: DataFrame, x: DataFrame, kind: str, times: int) -> DataFrame:
    """times F (or C) smooths: x_f += inv(a_ff) (b_f - a_fc x_c - a_ff x_f); the part from the other points is computed once."""
    own = fine_set(level.cf) if kind == "f" else coarse_set(level.cf)
    inner, outer, inverse = ("aff", "afc", level.inv_ff) if kind == "f" else ("acc", "acf", level.inv_cc)
    rhs = materialize(al.combine(al.gather(b, own), (-1.0, level.times(outer, x))), "rhs")
    part = al.gather(x, own)
    for _ in range(times):
        part = materialize(al.combine(part, (1.0, inverse.apply(al.combine(rhs, (-1.0, level.times(inner, part)))))), "smooth")
    return al.scatter(x, part)
