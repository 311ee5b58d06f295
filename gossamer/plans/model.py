"""Data model: matrices, vectors, enumerations and options.

A matrix is a DataFrame (i LONG, j LONG, v DOUBLE) with unique (i, j); a
vector is (i LONG, x DOUBLE) with every row present; an index set is (i);
markers are (i, cf) with 1 = C and -1 = F; a pattern is (i, j).  A missing
entry is a structural zero; explicit zeros are kept unless an operator says
otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C_POINT, F_POINT = 1, -1


class InverseType(IntEnum):
    POWER = 0
    ARNOLDI = 1
    NEWTON = 2
    NEWTON_NO_EXTRA = 3
    NEUMANN = 4
    SAI = 5
    ISAI = 6
    WJACOBI = 7
    JACOBI = 8


class ZType(IntEnum):
    PRODUCT = 0
    LAIR = 1
    LAIR_SAI = 2


class SplittingType(IntEnum):
    PMISR_DDC = 0
    DIAG_DOM = 1
    PMIS = 2
    PMIS_DIST2 = 3
    AGG = 4
    PMIS_AGG = 5
    CR = 6


@dataclass(frozen=True)
class SparseMatrix:
    """Entries and declared sizes; sizes cannot be told from the entries when trailing rows are empty."""

    df: DataFrame
    n_rows: int
    n_cols: int

    def __matmul__(self, other):
        from gossamer.operators import algebra

        if isinstance(other, SparseVector):
            if self.n_cols != other.n:
                raise ValueError(f"{self.n_cols} columns and {other.n} rows do not match")
            return SparseVector(algebra.fill(algebra.spmv(self.df, other.df), algebra.index_set(self.df.sparkSession, self.n_rows)), self.n_rows)
        if self.n_cols != other.n_rows:
            raise ValueError(f"{self.n_cols} columns and {other.n_rows} rows do not match")
        return SparseMatrix(algebra.spgemm(self.df, other.df), self.n_rows, other.n_cols)

    def __add__(self, other: SparseMatrix) -> SparseMatrix:
        return self.axpy(1.0, other)

    def __sub__(self, other: SparseMatrix) -> SparseMatrix:
        return self.axpy(-1.0, other)

    def axpy(self, alpha: float, other: SparseMatrix) -> SparseMatrix:
        from gossamer.operators import algebra

        if (self.n_rows, self.n_cols) != (other.n_rows, other.n_cols):
            raise ValueError("sizes do not match")
        return SparseMatrix(algebra.axpy(self.df, alpha, other.df), self.n_rows, self.n_cols)

    @property
    def T(self) -> SparseMatrix:
        from gossamer.operators import algebra

        return SparseMatrix(algebra.transpose(self.df), self.n_cols, self.n_rows)

    def scale(self, alpha: float) -> SparseMatrix:
        return SparseMatrix(self.df.withColumn("v", F.col("v") * alpha), self.n_rows, self.n_cols)

    @property
    def nnz(self) -> int:
        return self.df.count()

    @classmethod
    def from_triples(cls, df: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
        """Assembles triples: negative indices are ignored, repeated entries are added up."""
        from gossamer.operators import algebra

        return cls(algebra.assemble(df), n_rows, n_cols)


@dataclass(frozen=True)
class SparseVector:
    df: DataFrame
    n: int


@dataclass(frozen=True)
class InverseOptions:
    """Options of a single-level approximate inverse."""

    type: InverseType = InverseType.ARNOLDI
    poly_order: int = 6
    sparsity_order: int = 1
    matrix_free: bool = False
    reuse_poly_coeffs: bool = False
    diag_scale_polys: bool = False


@dataclass(frozen=True)
class Options:
    """Options of the hierarchy, with the names and defaults of the option table."""

    print_stats_timings: bool = False
    max_levels: int = 300
    coarse_eq_limit: int = 6
    auto_truncate_start_level: int = -1
    auto_truncate_tol: float = 1e-14
    r_drop: float = 0.01
    a_drop: float = 1e-4
    a_lump: bool = False
    processor_agglom: bool = True
    processor_agglom_ratio: float = 2.0
    processor_agglom_factor: int = 2
    process_eq_limit: int = 50
    subcomm: bool = False
    cf_splitting_type: SplittingType = SplittingType.PMISR_DDC
    strong_threshold: float = 0.5
    max_luby_steps: int = -1
    ddc_its: int = 1
    ddc_fraction: float = 0.1
    inverse_type: InverseType = InverseType.ARNOLDI
    poly_order: int = 6
    inverse_sparsity_order: int = 1
    diag_scale_polys: bool = False
    matrix_free_polys: bool = False
    smooth_type: str = "ff"
    full_smoothing_up_and_down: bool = False
    c_inverse_type: InverseType | None = None
    c_poly_order: int | None = None
    c_inverse_sparsity_order: int | None = None
    one_point_classical_prolong: bool = True
    symmetric: bool = False
    strong_r_threshold: float = 0.0
    z_type: ZType = ZType.PRODUCT
    lair_distance: int = 2
    constrain_w: bool = False
    constrain_z: bool = False
    improve_w_its: int = 0
    improve_z_its: int = 0
    coarsest_inverse_type: InverseType = InverseType.ARNOLDI
    coarsest_poly_order: int = 6
    coarsest_inverse_sparsity_order: int = 1
    coarsest_matrix_free_polys: bool = False
    coarsest_diag_scale_polys: bool = False
    coarsest_subcomm: bool = False
    reuse_sparsity: bool = False
    reuse_amount: int = 3
    reuse_poly_coeffs: bool = False

    def with_(self, **changes) -> Options:
        return replace(self, **changes)

    def inverse(self) -> InverseOptions:
        return InverseOptions(self.inverse_type, self.poly_order, self.inverse_sparsity_order, self.matrix_free_polys, self.reuse_poly_coeffs, self.diag_scale_polys)

    def c_inverse(self) -> InverseOptions:
        """The three C options follow the F values when unset."""
        pick = lambda own, other: other if own is None else own
        return replace(self.inverse(), type=pick(self.c_inverse_type, self.inverse_type), poly_order=pick(self.c_poly_order, self.poly_order), sparsity_order=pick(self.c_inverse_sparsity_order, self.inverse_sparsity_order))

    def coarsest_inverse(self) -> InverseOptions:
        return InverseOptions(self.coarsest_inverse_type, self.coarsest_poly_order, self.coarsest_inverse_sparsity_order, self.coarsest_matrix_free_polys, self.reuse_poly_coeffs, self.coarsest_diag_scale_polys)

    def groups(self) -> list[tuple[str, int]]:
        """The smoothing schedule as runs: "fcf" is [("f", 1), ("c", 1), ("f", 1)]."""
        if set(self.smooth_type) - {"f", "c"}:
            raise ValueError("a smoothing schedule is made of f and c")
        runs: list[tuple[str, int]] = []
        for kind in self.smooth_type:
            runs = [*runs[:-1], (kind, runs[-1][1] + 1)] if runs and runs[-1][0] == kind else [*runs, (kind, 1)]
        return runs


#: Names of the timed parts.
TIMERS = ("setup", "inverse", "drop", "rap", "extract", "prolong", "restrict", "proc agglom", "coarsen", "constrain", "identity", "truncate")


@dataclass
class Timers:
    """Seconds spent in each named part."""

    seconds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TIMERS, 0.0))

    def timed(self, name: str):
        from contextlib import contextmanager
        from time import perf_counter

        @contextmanager
        def run():
            began = perf_counter()
            try:
                yield
            finally:
                self.seconds[name] = self.seconds.get(name, 0.0) + perf_counter() - began

        return run()

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.seconds.items()), "name string, seconds double")
