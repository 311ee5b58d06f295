"""Grid transfer (R), multigrid (M), statistics (A10) and outer solvers (K)."""

from pyspark.sql import functions as F

from gossamer.catalog import query, with_base
from gossamer.catalog.algebra import rounded, sets
from gossamer.catalog.chains import Chain, Cycle, local_pattern
from gossamer.catalog.inverses import _polynomial_sql, dominant, scaled
from gossamer.operators import algebra as al
from gossamer.operators import inverse as inv
from gossamer.operators import splitting as sp
from gossamer.operators import transfer as tr
from gossamer.operators.partition import active_parts
from gossamer.plans import krylov
from gossamer.plans.log import log_lines, parse_logs, parse_stages
from gossamer.plans.model import InverseOptions, InverseType, Options, SplittingType, ZType
from gossamer.plans.multigrid import Hierarchy, Level, smooth
from gossamer.session import fresh, materialize, prepare, read_table
from gossamer.sources import generators as g
from gossamer.sources import tables as t

#: Blocks of the dominant matrix and the Jacobi inverse of its fine block.
BLOCKS = """
FF AS (SELECT D.* FROM D JOIN fine f ON f.i = D.i JOIN fine g ON g.i = D.j),
FC AS (SELECT D.* FROM D JOIN fine f ON f.i = D.i JOIN coarse g ON g.i = D.j),
CFB AS (SELECT D.* FROM D JOIN coarse f ON f.i = D.i JOIN fine g ON g.i = D.j),
Z AS (SELECT CFB.i, CFB.j, -v * d AS v FROM CFB JOIN Jinv ON Jinv.i = CFB.j),
W AS (SELECT i, j, 1.0::DOUBLE AS v FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS k FROM FC) WHERE k = 1),
R AS (SELECT i, j, v FROM Z UNION ALL SELECT i, i, 1.0 FROM coarse),
P AS (SELECT i, j, v FROM W UNION ALL SELECT i, i, 1.0 FROM coarse)
"""


def blocks(spark, sf_dir):
    """(a, fine, coarse, aff, afc, acf, diagonal inverse of aff)."""
    a, _ = dominant(spark, sf_dir)
    fine, coarse = sets(spark, sf_dir)
    aff = al.submatrix(a, fine, fine)
    return a, fine, coarse, aff, al.submatrix(a, fine, coarse), al.submatrix(a, coarse, fine), inv.jacobi(aff, fine, weighted=False)


@query("R1_ideal_restriction", with_base("SELECT i, j, round(v, 9) AS v FROM Z", BLOCKS))
def r1(spark, sf_dir):
    _, _, _, _, _, acf, m = blocks(spark, sf_dir)
    return rounded(tr.ideal_z(acf, m), 9)


def _split_blocks(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    cf = materialize(sp.compute_cf_splitting(a, rows), "markers")
    fine, coarse = sp.fine_set(cf), sp.coarse_set(cf)
    return al.submatrix(a, fine, fine), al.submatrix(a, coarse, fine)


def _local_sql(square, steps):
    c = Chain()
    cf = c.ddc("D", c.pmisr(c.strong("D", 0.5), "part_rows", 14), 0.1)
    fine, coarse = (c.add(f"SELECT i FROM {cf} WHERE cf = {k}") for k in (-1, 1))
    aff, acf = c.block("D", fine, fine), c.block("D", coarse, fine)
    pattern, rhs = local_pattern(c, aff, acf), c.add(f"SELECT i, j, -v AS v FROM {acf}")
    z = (c.local_exact if square else c.local_least)(aff, pattern, rhs, steps)
    return c.sql(f"SELECT i, j, round(v, 9) AS v FROM {z}")


@query("R2_local_restriction", _local_sql(True, 40))
def r2(spark, sf_dir):
    return rounded(tr.local_z(*_split_blocks(spark, sf_dir), distance=2), 9)


@query("R3_local_restriction_least_squares", _local_sql(False, 40))
def r3(spark, sf_dir):
    return rounded(tr.local_z(*_split_blocks(spark, sf_dir), distance=2, square=False), 9)


@query("R4_one_point", with_base("SELECT i, j, v FROM W", BLOCKS))
def r4(spark, sf_dir):
    return tr.one_point(blocks(spark, sf_dir)[4])


@query("R5_ideal_prolongation", with_base("SELECT FC.i, FC.j, round(-v * d, 9) AS v FROM FC JOIN Jinv ON Jinv.i = FC.i", BLOCKS))
def r5(spark, sf_dir):
    _, _, _, _, afc, _, m = blocks(spark, sf_dir)
    return rounded(tr.ideal_w(m, afc), 9)


@query("R6_symmetric_prolongator", with_base("SELECT j AS i, i AS j, round(v, 9) AS v FROM R", BLOCKS))
def r6(spark, sf_dir):
    _, _, coarse, _, _, acf, m = blocks(spark, sf_dir)
    return rounded(al.transpose(tr.restrictor(tr.ideal_z(acf, m), coarse)), 9)


@query("R7_prolongator", with_base("SELECT i, j, v FROM P", BLOCKS))
def r7(spark, sf_dir):
    _, _, coarse, _, afc, _, _ = blocks(spark, sf_dir)
    return tr.prolongator(tr.one_point(afc), coarse)


@query("R8_restrictor", with_base("SELECT i, j, round(v, 9) AS v FROM R", BLOCKS))
def r8(spark, sf_dir):
    _, _, coarse, _, _, acf, m = blocks(spark, sf_dir)
    return rounded(tr.restrictor(tr.ideal_z(acf, m), coarse), 9)


@query("R9_dropped_restriction", with_base("SELECT i, j, round(v, 9) AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM Z) WHERE abs(v) >= 0.5 * m", BLOCKS))
def r9(spark, sf_dir):
    _, _, _, _, _, acf, m = blocks(spark, sf_dir)
    return rounded(al.remove_small(tr.ideal_z(acf, m), 0.5, relative=1, drop_diagonal=1), 9)


@query("R10_strong_entries", with_base("SELECT i, j, v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM D) WHERE i = j OR abs(v) >= 0.1 * m"))
def r10(spark, sf_dir):
    return al.remove_small(t.dominant(spark, sf_dir), 0.1, relative=1)


_STEP = "G AS (SELECT i, j, sum(v) AS v FROM (SELECT FF.i, W.j, FF.v * W.v AS v FROM FF JOIN W ON W.i = FF.j UNION ALL SELECT i, j, v FROM FC) GROUP BY i, j), H AS (SELECT i, j, sum(v) AS v FROM (SELECT Z.i, FF.j, Z.v * FF.v AS v FROM Z JOIN FF ON FF.i = Z.j UNION ALL SELECT i, j, v FROM CFB) GROUP BY i, j)"


@query("R11_improve_w", with_base("SELECT W.i, W.j, round(W.v - Jinv.d * coalesce(G.v, 0.0), 9) AS v FROM W JOIN Jinv ON Jinv.i = W.i LEFT JOIN G ON G.i = W.i AND G.j = W.j", BLOCKS + ", " + _STEP))
def r11(spark, sf_dir):
    _, fine, _, aff, afc, _, m = blocks(spark, sf_dir)
    return rounded(tr.improve_w(tr.one_point(afc), aff, afc, al.diagonal(m, fine)), 9)


@query("R11_improve_z", with_base("SELECT Z.i, Z.j, round(Z.v - coalesce(H.v, 0.0) * Jinv.d, 9) AS v FROM Z JOIN Jinv ON Jinv.i = Z.j LEFT JOIN H ON H.i = Z.i AND H.j = Z.j", BLOCKS + ", " + _STEP))
def r11_z(spark, sf_dir):
    _, fine, _, aff, _, acf, m = blocks(spark, sf_dir)
    return rounded(tr.improve_z(materialize(tr.ideal_z(acf, m), "z"), aff, acf, al.diagonal(m, fine)), 9)


@query("R12_constrained", with_base("SELECT i, j, round(v - (t - 1.0) / n, 9) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY i) AS t, count(*) OVER (PARTITION BY i) AS n FROM (SELECT FC.i, FC.j, -v * d AS v FROM FC JOIN Jinv ON Jinv.i = FC.i))", BLOCKS))
def r12(spark, sf_dir):
    _, fine, coarse, _, afc, _, m = blocks(spark, sf_dir)
    return rounded(tr.constrain(tr.ideal_w(m, afc), tr.constant_vector(coarse), tr.constant_vector(fine)), 9)


_SMOOTH = """
r0 AS (SELECT x.i, -coalesce(s, 0.0) AS x FROM x LEFT JOIN (SELECT D.i, sum(v * x) AS s FROM D JOIN x ON x.i = D.j GROUP BY D.i) t ON t.i = x.i),
q0 AS (SELECT r0.i, r0.x, coalesce(s, 0.0) AS y FROM r0 LEFT JOIN (SELECT D.i, sum(v * x) AS s FROM D JOIN r0 ON r0.i = D.j GROUP BY D.i) t ON t.i = r0.i)
"""


@query("R13_smoothed_vector", with_base("SELECT x.i, round(x.x + (SELECT sum(x * y) / sum(y * y) FROM q0) * r0.x, 6) AS x FROM x JOIN r0 ON r0.i = x.i", _SMOOTH))
def r13(spark, sf_dir):
    a, _ = dominant(spark, sf_dir)
    return rounded(tr.smooth_vector(a, t.part_sizes(spark, sf_dir), iterations=1))


@query("R14_constant_vector", with_base("SELECT i, 1.0::DOUBLE AS x FROM part_rows"))
def r14(spark, sf_dir):
    return tr.constant_vector(t.part_rows(spark, sf_dir)).select("i", F.col("xs")[0].alias("x"))


_COARSE = BLOCKS + ", AP AS (SELECT D.i, P.j, sum(D.v * P.v) AS v FROM D JOIN P ON P.i = D.j GROUP BY 1, 2), AC AS (SELECT R.i, AP.j, sum(R.v * AP.v) AS v FROM R JOIN AP ON AP.i = R.j GROUP BY 1, 2)"


@query("R15_coarse_matrix", with_base("SELECT i, j, round(v, 6) AS v FROM AC", _COARSE))
def r15(spark, sf_dir):
    a, _, coarse, _, afc, acf, m = blocks(spark, sf_dir)
    return rounded(tr.coarse_matrix(a, tr.restrictor(tr.ideal_z(acf, m), coarse), tr.prolongator(tr.one_point(afc), coarse), a_drop=0.0))


@query("R15_coarse_matrix_lumped", with_base("SELECT i, CASE WHEN i = j OR abs(v) >= 0.02 * m THEN j ELSE i END AS j, round(sum(v), 6) AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM AC) GROUP BY 1, 2", _COARSE))
def r15_lumped(spark, sf_dir):
    a, _, coarse, _, afc, acf, m = blocks(spark, sf_dir)
    return rounded(tr.coarse_matrix(a, tr.restrictor(tr.ideal_z(acf, m), coarse), tr.prolongator(tr.one_point(afc), coarse), a_drop=0.02, lump=True))


# --- M


_RHS = "b AS (SELECT i, x AS b FROM x)"


def _level(spark, sf_dir, both=False):
    a, fine, coarse, aff, afc, acf, _ = blocks(spark, sf_dir)
    rows = t.part_rows(spark, sf_dir)
    cf = materialize(t.part_markers(spark, sf_dir), "markers")
    acc = al.submatrix(a, coarse, coarse)
    jacobi = InverseOptions(InverseType.JACOBI)
    built = inv.ApproxInverse.build(aff, fine, jacobi), inv.ApproxInverse.build(acc, coarse, jacobi)
    return Level(a, rows, 0, 0, cf, aff, afc, acf, acc, *built)


@query("M6_f_smooth", with_base("SELECT x.i, CASE WHEN cf = -1 THEN round(2.0 + d * (x - 2.0 * s), 6) ELSE 2.0 END AS x FROM x JOIN cf ON cf.i = x.i JOIN Jinv ON Jinv.i = x.i JOIN (SELECT i, sum(v) AS s FROM D GROUP BY i) t ON t.i = x.i"))
def m6(spark, sf_dir):
    b = t.part_sizes(spark, sf_dir)
    return rounded(smooth(_level(spark, sf_dir), b, b.select("i", F.lit(2.0).alias("x")), "f", 1))


@query("M7_c_smooth", with_base("SELECT x.i, CASE WHEN cf = 1 THEN round(2.0 + d * (x - 2.0 * s), 6) ELSE 2.0 END AS x FROM x JOIN cf ON cf.i = x.i JOIN Jinv ON Jinv.i = x.i JOIN (SELECT i, sum(v) AS s FROM D GROUP BY i) t ON t.i = x.i"))
def m7(spark, sf_dir):
    b = t.part_sizes(spark, sf_dir)
    return rounded(smooth(_level(spark, sf_dir), b, b.select("i", F.lit(2.0).alias("x")), "c", 1))


@query("M8_schedule", "SELECT * FROM (VALUES (0, 'f', 2), (1, 'c', 1), (2, 'f', 1)) s(place, kind, times)")
def m8(spark, sf_dir):
    return spark.createDataFrame([(k, *x) for k, x in enumerate(Options(smooth_type="ffcf").groups())], "place int, kind string, times int")


#: The coarsest inverse is applied by products, as the coarse matrices of these tables fill in.
SMALL = Options(poly_order=2, coarsest_inverse_type=InverseType.NEUMANN, coarsest_poly_order=4, coarsest_matrix_free_polys=True, max_levels=3, inverse_type=InverseType.NEUMANN, strong_threshold=0.5)


def _grid(spark, n):
    return g.upwind_diffusion_2d(prepare(spark), n, 0.01), al.index_set(spark, n * n)


def _stats_sql(levels, **options):
    c = Chain()
    return c.sql(Cycle(c, levels, **options).stats())


def _cycle_sql(levels, **options):
    c = Chain()
    x = Cycle(c, levels, **options).apply(c.add("SELECT i, x FROM x"))
    return c.sql(f"SELECT i, round(x, 6) AS x FROM {x}")


def _truncated_sql():
    """The level is the only one, as the coarsest inverse is good enough on it."""
    c = Chain()
    h, b = Cycle(c, 1), c.start_vector("part_rows", "truncate")
    miss = c.combine(("1.0", b), ("-1.0", c.spmv("D", h.apply(b), "part_rows")))
    return c.sql(f"SELECT * FROM ({h.stats()}) WHERE (SELECT sum(x * x) FROM {miss}) < 0.81 * (SELECT sum(x * x) FROM {b})")


def _complexity_sql(levels):
    c = Chain()
    h = Cycle(c, levels)
    n = lambda name: f"(SELECT count(*) FROM {name})"
    top = h.levels[0]
    cycle = [f"4 * {n(h.last)}"] + [f"2 * ({n(lv.pattern)} + {n(lv.aff)}) + {n(lv.afc)} + {n(lv.r)} + {n(lv.p)}" for lv in h.levels]
    stored = [n(h.last)] + [n(x) for lv in h.levels for x in (lv.aff, lv.afc, lv.acf, lv.acc, lv.r, lv.p, lv.pattern)]
    every = {
        "grid": ([n(lv.rows) for lv in h.levels] + [n(h.last_rows)], top.rows), "operator": ([n(lv.a) for lv in h.levels] + [n(h.last)], top.a),
        "cycle": (cycle, top.a), "storage": (stored, top.a), "reuse_storage": (["0"], top.a),
    }
    return c.sql(" UNION ALL ".join(f"SELECT '{k}' AS name, round(({' + '.join(v)}) / {n(over)}::DOUBLE, 6) AS value" for k, (v, over) in every.items()))


_TIMERS = "SELECT * FROM (VALUES ('setup', true), ('coarsen', true), ('extract', true), ('proc agglom', true), ('inverse', true), ('restrict', true), ('prolong', true), ('constrain', false), ('rap', true), ('identity', true), ('drop', true), ('truncate', false)) t(name, used)"


def _build(name, measure, sql=None, **options):
    def run(spark, sf_dir):
        a, rows = dominant(spark, sf_dir)
        h = Hierarchy.build(a, rows, SMALL.with_(**options))
        return measure(h, a, t.part_sizes(spark, sf_dir))

    query(name, sql)(run)


_build("M1_hierarchy", lambda h, a, b: h.stats_df(), _stats_sql(3))
_build("M2_coarse_limit", lambda h, a, b: h.stats_df(), _stats_sql(3, coarse_limit=150), coarse_eq_limit=150)
_build("M3_auto_truncation", lambda h, a, b: h.stats_df(), _truncated_sql(), auto_truncate_start_level=0, auto_truncate_tol=0.9)
_build("M5_single_level", lambda h, a, b: h.stats_df(), _stats_sql(1), max_levels=1)
_build("M9_full_smoothing", lambda h, a, b: rounded(h.apply(b)), _cycle_sql(2, full=True), full_smoothing_up_and_down=True, max_levels=2)
_build("M10_cycle", lambda h, a, b: rounded(h.apply(b)), _cycle_sql(3))
_build("M10_krylov_cycle", lambda h, a, b: rounded(h.apply(b)), _cycle_sql(2, krylov=True), inverse_type=InverseType.ARNOLDI, diag_scale_polys=True, max_levels=2)
_build("M12_apply_preconditioner", lambda h, a, b: rounded(h.apply(b)), _cycle_sql(2, schedule="fc"), smooth_type="fc", max_levels=2)
_build("M16_timers", lambda h, a, b: h.timers.df(a.sparkSession).selectExpr("name", "seconds > 0 as used"), _TIMERS, max_levels=2)
_build("A10_complexities", lambda h, a, b: a.sparkSession.createDataFrame([(k, round(float(v), 6)) for k, v in sorted(h.complexities().items())], "name string, value double"), _complexity_sql(3))
def _logged(h, a, b):
    """What the setup prints, written as a log and read back; what belongs to no level has level -1."""
    spark, path = a.sparkSession, fresh(a.sparkSession, "log")
    spark.createDataFrame([("\n".join(log_lines(h)),)], "value string").write.text(path)
    return rounded(parse_logs(spark, path).where("kind not like '% time'").select("kind", F.coalesce("level", F.lit(-1)).alias("level"), "value"))


def _log_sql(levels):
    stats = Chain()
    body = Cycle(stats, levels).stats()
    every = "SELECT 'rows' AS kind, level, n_rows::DOUBLE AS value FROM s UNION ALL SELECT 'fine', level, fine_rows::DOUBLE FROM s WHERE fine_rows > 0 UNION ALL SELECT 'coarse', level, (n_rows - fine_rows)::DOUBLE FROM s WHERE fine_rows > 0"
    complexity = f"SELECT replace(name, '_', ' ') || ' complexity' AS kind, -1::INTEGER AS level, value FROM ({_complexity_sql(levels)})"
    return f"WITH s AS ({stats.sql(body)}) {every} UNION ALL {complexity}"


@query("S9_stages", "SELECT o_orderpriority AS stage, count(*) AS solves, round(sum(o_totalprice), 2) AS seconds FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def s9_stages(spark, sf_dir):
    """Orders as solves, priorities as the stages of a log view, written as a log and read back."""
    path = fresh(spark, "log")
    stages = read_table(spark, sf_dir, "orders").where("o_orderpriority is not null").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    text = F.concat(F.lit("--- Event Stage 7: "), "stage", F.lit("\n\nMatMult 5 1.0 1.0e+00 1.0\nKSPSolve "), F.col("n").cast("string"), F.lit(" 1.0 "), F.col("s").cast("decimal(20,2)").cast("string"), F.lit(" 1.0 0.00e+00\n"))
    stages.select(text.alias("value")).write.text(path)
    return parse_stages(spark, path).select("stage", "solves", "seconds")


_build("S9_statistics", _logged, _log_sql(3))
_build("R2_hierarchy_local", lambda h, a, b: h.stats_df(), _stats_sql(2, local=40), z_type=ZType.LAIR, max_levels=2)


@query("M4_diagonal_block", "SELECT 1 AS times")
def m4(spark, sf_dir):
    """Where a_ff is diagonal each F group smooths once."""
    a = g.advection_1d(prepare(spark), 32)
    h = Hierarchy.build(a, al.index_set(spark, 32), Options(poly_order=3, max_levels=2, inverse_type=InverseType.NEUMANN, cf_splitting_type=SplittingType.PMISR_DDC))
    return spark.createDataFrame([(h.levels[0].groups[0][1],)], "times int")


@query("M11_coarse_solve", _polynomial_sql(4))
def m11(spark, sf_dir):
    m = inv.ApproxInverse.build(*scaled(spark, sf_dir), InverseOptions(InverseType.ARNOLDI, 4, matrix_free=True))
    return rounded(m.apply(t.part_sizes(spark, sf_dir)))


@query("M13_reuse", "SELECT * FROM (VALUES ('frozen', true), ('same pattern', true), ('new pattern', false)) r(kind, reused)")
def m13(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    gone = a.where("i <> j").orderBy("i", "j").first()
    o = SMALL.with_(reuse_sparsity=True, max_levels=2)
    h = Hierarchy.build(a, rows, o)
    again = h.rebuild(a.withColumn("v", 2 * F.col("v")), rows)
    other = h.rebuild(a.where((F.col("i") != gone.i) | (F.col("j") != gone.j)), rows)
    h.frozen = True
    found = [("frozen", h.rebuild(a, rows) is h), ("same pattern", again.levels[0].cf is h.levels[0].cf), ("new pattern", other.levels[0].cf is h.levels[0].cf)]
    return spark.createDataFrame(found, "kind string, reused boolean")


@query("M14_agglomeration", with_base("SELECT CASE WHEN n >= 400 THEN 4 WHEN n >= 100 THEN 2 ELSE 1 END::INTEGER AS parts, round(near / far, 9) AS ratio FROM (SELECT count(*) AS n FROM part_rows), (SELECT count(*) FILTER (i % 8 = j % 8) AS near, count(*) FILTER (i % 8 <> j % 8)::DOUBLE AS far FROM D)"))
def m14(spark, sf_dir):
    """Partitions that the matrix keeps of eight, by its rows and its share of local entries."""
    a, rows = dominant(spark, sf_dir)
    ratio = al.locality(a, 8).first().ratio
    return spark.createDataFrame([(active_parts(8, rows.count(), ratio), round(ratio, 9))], "parts int, ratio double")


# --- K


def _history(norms):
    return " UNION ALL ".join(f"SELECT {k}::INTEGER AS iteration, round({x}, 6) AS residual" for k, x in enumerate(norms))


def _richardson_sql(levels, its):
    c = Chain()
    h, b = Cycle(c, levels), c.add("SELECT i, x FROM x")
    r, norms = b, []
    for k in range(its + 1):
        norms.append(f"(SELECT sqrt(sum(x * x)) FROM {r})")
        if k < its:
            r = c.combine(("1.0", r), ("-1.0", c.spmv("D", h.apply(r), "part_rows")))
    return c.sql(_history(norms))


def _gmres_sql(levels, its):
    """Residuals from the least-squares problems over the products of a M, without an orthogonal basis."""
    c = Chain()
    h, b = Cycle(c, levels), c.add("SELECT i, x FROM x")
    vectors = []
    for _ in range(its):
        vectors.append(c.spmv("D", h.apply(vectors[-1] if vectors else b), "part_rows"))
    left = [b]
    for m in range(1, its + 1):
        row = c.solve(vectors[:m], b)
        left.append(c.combine(("1.0", b), *((f"(SELECT -c_{k} FROM {row})", v) for k, v in enumerate(vectors[:m]))))
    return c.sql(_history([f"(SELECT sqrt(sum(x * x)) FROM {v})" for v in left]))


def _solve(name, solver, sql, max_it, **options):
    """A fixed number of iterations, whose residuals can be compared with SQL's; tests and README have solves to a tolerance."""

    def run(spark, sf_dir):
        a, rows = dominant(spark, sf_dir)
        h = Hierarchy.build(a, rows, SMALL.with_(**options))
        return rounded(solver(a, t.part_sizes(spark, sf_dir), h.apply, max_it=max_it).history())

    query(name, sql)(run)


_solve("K1_richardson", krylov.richardson, _richardson_sql(2, 3), 3, max_levels=2)
_solve("K2_gmres", krylov.gmres, _gmres_sql(2, 3), 3, max_levels=2)


def _restarted_sql(restart, its):
    """Jacobi-preconditioned: each cycle's residuals from the least-squares problems over its own products."""
    c = Chain()
    d, r = c.add("SELECT i, 1.0 / v AS d FROM D WHERE i = j"), c.add("SELECT i, x FROM x")
    left = [r]
    while len(left) <= its:
        vectors = []
        for m in range(1, min(restart, its + 1 - len(left)) + 1):
            scaled_last = c.add(f"SELECT x.i, x.x * d.d AS x FROM {vectors[-1] if vectors else r} x JOIN {d} d ON d.i = x.i")
            vectors.append(c.spmv("D", scaled_last, "part_rows"))
            row = c.solve(vectors, r)
            left.append(c.combine(("1.0", r), *((f"(SELECT -c_{k} FROM {row})", v) for k, v in enumerate(vectors))))
            if m == restart:
                break
        r = left[-1]
    return c.sql(_history([f"(SELECT sqrt(sum(x * x)) FROM {v})" for v in left]))


@query("K2_gmres_restarted", _restarted_sql(3, 7))
def k2_restarted(spark, sf_dir):
    """Three cycles of at most three steps."""
    a, rows = dominant(spark, sf_dir)
    m = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.JACOBI))
    return rounded(krylov.gmres(materialize(a, "system"), t.part_sizes(spark, sf_dir), m.apply, max_it=7, restart=3).history())


@query("K3_residual_history", with_base("SELECT 0 AS iteration, round(sqrt(sum(x * x)), 6) AS residual FROM x UNION ALL SELECT 1, round(sqrt(sum((x - coalesce(s, 0.0)) ** 2)), 6) FROM x LEFT JOIN (SELECT D.i, sum(v * d * x) AS s FROM D JOIN Jinv ON Jinv.i = D.j JOIN x ON x.i = D.j GROUP BY D.i) t ON t.i = x.i"))
def k3(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    m = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.JACOBI))
    return rounded(krylov.richardson(a, t.part_sizes(spark, sf_dir), m.apply, max_it=1).history())


def _factors(c, sweeps):
    low = c.add("SELECT D.i, D.j, D.v / p.v AS v FROM D JOIN D p ON p.i = D.j AND p.j = D.j WHERE D.i > D.j")
    up = c.add("SELECT i, j, v FROM D WHERE i <= j")
    for _ in range(sweeps):
        rest = c.add(f"SELECT D.i, D.j, D.v - coalesce(s, 0.0) AS v FROM D LEFT JOIN (SELECT l.i, u.j, sum(l.v * u.v) AS s FROM {low} l JOIN {up} u ON u.i = l.j WHERE l.j < least(l.i, u.j) GROUP BY 1, 2) t ON t.i = D.i AND t.j = D.j")
        low = c.add(f"SELECT r.i, r.j, r.v / p.v AS v FROM {rest} r JOIN {up} p ON p.i = r.j AND p.j = r.j WHERE r.i > r.j")
        up = c.add(f"SELECT i, j, v FROM {rest} WHERE i <= j")
    return low, up


def _factors_sql(sweeps):
    c = Chain()
    low, up = _factors(c, sweeps)
    return c.sql(f"SELECT 'L' AS factor, i, j, round(v, 10) AS v FROM {low} UNION ALL SELECT 'L', i, i, 1.0 FROM part_rows UNION ALL SELECT 'U', i, j, round(v, 8) FROM {up}")


def _euler_sql(dt, steps, sweeps):
    """Each step by Jacobi sweeps, which converge as I + dt D is dominant."""
    c = Chain()
    d = c.add(f"SELECT i, 1.0 + {dt} * v AS d FROM D WHERE i = j")
    off = c.add(f"SELECT i, j, {dt} * v AS v FROM D WHERE i <> j")
    x = c.add("SELECT i, x FROM x")
    for _ in range(steps):
        b = x
        for _ in range(sweeps):
            x = c.add(f"SELECT b.i, (b.x - coalesce(s, 0.0)) / d.d AS x FROM {b} b JOIN {d} d ON d.i = b.i LEFT JOIN (SELECT a.i, sum(a.v * x.x) AS s FROM {off} a JOIN {x} x ON x.i = a.j GROUP BY a.i) t ON t.i = b.i")
    return c.sql(f"SELECT i, round(x, 6) AS x FROM {x}")


@query("K4_incomplete_factors", _factors_sql(3))
def k4(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    lower, upper = krylov.incomplete_factors(a, rows, 3)
    # Finer than the fractions of small powers of two that entries are, so that none lies half-way.
    return rounded(lower.select(F.lit("L").alias("factor"), "i", "j", "v"), 10).unionByName(rounded(upper.select(F.lit("U").alias("factor"), "i", "j", "v"), 8))


def _factor_solve_sql(sweeps, order):
    c = Chain()
    low, up = _factors(c, sweeps)
    b = x = c.add("SELECT i, x FROM x")
    for _ in range(order):
        x = c.combine(("1.0", b), ("-1.0", c.spmv(low, x, "part_rows")))
    d, off = c.add(f"SELECT i, 1.0 / v AS d FROM {up} WHERE i = j"), c.add(f"SELECT i, j, v FROM {up} WHERE i <> j")
    scaled_by = lambda v: c.add(f"SELECT v.i, v.x * d.d AS x FROM {v} v JOIN {d} d ON d.i = v.i")
    b = x = scaled_by(x)
    for _ in range(order):
        x = c.combine(("1.0", b), ("-1.0", scaled_by(c.spmv(off, x, "part_rows"))))
    return c.sql(f"SELECT i, round(x, 9) AS x FROM {x}")


@query("K4_factor_solve", _factor_solve_sql(2, 4))
def k4_solve(spark, sf_dir):
    """Both incomplete factors solved by Neumann polynomials of order 4."""
    a, rows = dominant(spark, sf_dir)
    lower, upper = krylov.incomplete_factors(a, rows, 2)
    apply = krylov.factor_solver(materialize(lower, "lower"), upper, rows, InverseOptions(InverseType.NEUMANN, 4, matrix_free=True))
    return rounded(apply(t.part_sizes(spark, sf_dir)), 9)


#: Short enough that a step is dominant by far, so that solves take a few iterations.
_DT = 0.001


@query("K5_time_steps", _euler_sql(_DT, 2, 50))
def k5(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)

    def solver(system):
        m = inv.ApproxInverse.build(system.a, rows, InverseOptions(InverseType.NEUMANN, 4, matrix_free=True), stored=system)
        return lambda b: krylov.gmres(system, b, m.apply, rtol=1e-11)

    return rounded(krylov.backward_euler(a, rows, t.part_sizes(spark, sf_dir), _DT, 2, solver))
