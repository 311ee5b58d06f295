"""Entry-wise operators (P), joins (J), aggregations (A), windows (W) and sets (U)."""

import numpy as np
from pyspark.sql import functions as F

from gossamer.catalog import query, with_base
from gossamer.functions.dense import modified_leja
from gossamer.functions.randoms import random_int, uniform
from gossamer.operators import algebra as al
from gossamer.operators import splitting as sp
from gossamer.operators.krylov_basis import powers, start_vector, tsqr
from gossamer.session import materialize
from gossamer.sources import generators as g
from gossamer.sources import tables as t


def sets(spark, sf_dir):
    cf = t.part_markers(spark, sf_dir)
    return sp.fine_set(cf), sp.coarse_set(cf)


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# --- P


@query("P1_remove_small", with_base("SELECT i, j, v FROM A WHERE abs(v) >= 30 OR i = j"))
def p1(spark, sf_dir):
    return al.remove_small(t.flow(spark, sf_dir), 30)


@query("P1_remove_small_relative", with_base("SELECT i, j, v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM A) WHERE abs(v) >= 0.8 * m"))
def p1_relative(spark, sf_dir):
    return al.remove_small(t.flow(spark, sf_dir), 0.8, relative=1, drop_diagonal=1)


@query("P1_remove_small_off_diagonal", with_base("SELECT i, j, v FROM (SELECT *, max(CASE WHEN i <> j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM A) WHERE i <> j AND abs(v) >= 0.8 * m"))
def p1_off(spark, sf_dir):
    return al.remove_small(t.flow(spark, sf_dir), 0.8, relative=-1, drop_diagonal=-1)


@query("P1_remove_small_diagonal", with_base("SELECT i, j, v FROM (SELECT *, max(CASE WHEN i = j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM D) WHERE i = j OR abs(v) >= 0.05 * m"))
def p1_diagonal(spark, sf_dir):
    return al.remove_small(t.dominant(spark, sf_dir), 0.05, diagonal_strength=True)


@query("P1_remove_small_lump", with_base("SELECT i, CASE WHEN i = j OR abs(v) >= 0.05 * m THEN j ELSE i END AS j, sum(v) AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM D) GROUP BY 1, 2"))
def p1_lump(spark, sf_dir):
    return al.remove_small(t.dominant(spark, sf_dir), 0.05, relative=1, lump=True)


@query("P2_restrict", with_base("SELECT s.i, s.j, coalesce(A.v, 0.0) AS v FROM SS s LEFT JOIN A ON A.i = s.i AND A.j = s.j"))
def p2(spark, sf_dir):
    from gossamer.operators.strength import strength

    a = t.flow(spark, sf_dir)
    return al.restrict(a, strength(a, 0.5))


@query("P2_restrict_lump", with_base("SELECT D.i, CASE WHEN S.i IS NOT NULL THEN D.j ELSE D.i END AS j, sum(D.v) AS v FROM D LEFT JOIN S ON S.i = D.i AND S.j = D.j GROUP BY 1, 2"))
def p2_lump(spark, sf_dir):
    from gossamer.operators.strength import strength

    return al.restrict(t.dominant(spark, sf_dir), strength(t.flow(spark, sf_dir), 0.5, symmetrize=False), lump=True)


@query("P2_restrict_add", with_base("SELECT A.i, A.j, A.v + 0.5 * coalesce(D.v, 0.0) AS v FROM A LEFT JOIN D ON D.i = A.i AND D.j = A.j"))
def p2_add(spark, sf_dir):
    return al.restrict_add(t.flow(spark, sf_dir), t.dominant(spark, sf_dir), 0.5)


@query("P3_set_values", with_base("SELECT i, j, 1.0::DOUBLE AS v FROM A"))
def p3(spark, sf_dir):
    return al.set_values(t.flow(spark, sf_dir), 1.0)


@query("P4_with_diagonal", with_base("SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT i, i, 0.0 FROM part_rows) GROUP BY i, j"))
def p4(spark, sf_dir):
    return al.with_diagonal(t.flow(spark, sf_dir), t.part_rows(spark, sf_dir))


@query("P5_submatrix", with_base("SELECT i, j, v FROM A WHERE i IN (SELECT i FROM fine) AND j IN (SELECT i FROM coarse)"))
def p5(spark, sf_dir):
    return al.submatrix(t.flow(spark, sf_dir), *sets(spark, sf_dir))


@query("P5_submatrix_renumbered", with_base("SELECT f.k AS i, c.k AS j, v FROM A JOIN (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM fine) f ON f.i = A.i JOIN (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM coarse) c ON c.i = A.j"))
def p5_renumbered(spark, sf_dir):
    return al.submatrix(t.flow(spark, sf_dir), *sets(spark, sf_dir), renumbered=True)


@query("P5_split_blocks", with_base("SELECT A.i, A.j, A.v, r.cf AS cf_i, c.cf AS cf_j FROM A JOIN cf r ON r.i = A.i JOIN cf c ON c.i = A.j"))
def p5_blocks(spark, sf_dir):
    return al.split_blocks(t.flow(spark, sf_dir), t.part_markers(spark, sf_dir))


@query("P6_diagonal", with_base("SELECT r.i, coalesce(v, 0.0) AS x FROM part_rows r LEFT JOIN A ON A.i = r.i AND A.j = r.i"))
def p6(spark, sf_dir):
    return al.diagonal(t.flow(spark, sf_dir), t.part_rows(spark, sf_dir))


@query("P7_scale_rows", with_base("SELECT A.i, j, x * v AS v FROM A JOIN x ON x.i = A.i"))
def p7(spark, sf_dir):
    return al.scale_rows(t.flow(spark, sf_dir), t.part_sizes(spark, sf_dir))


@query("P7_scale_cols", with_base("SELECT A.i, A.j, x * v AS v FROM A JOIN x ON x.i = A.j"))
def p7_cols(spark, sf_dir):
    return al.scale_cols(t.flow(spark, sf_dir), t.part_sizes(spark, sf_dir))


@query("P8_identity_minus", with_base("SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, 1.0 AS v FROM part_rows UNION ALL SELECT i, j, -v FROM A) GROUP BY i, j"))
def p8(spark, sf_dir):
    return al.identity_minus(t.flow(spark, sf_dir), t.part_rows(spark, sf_dir))


@query("P9_is_diagonal", "SELECT 'flow' AS name, false AS diagonal UNION ALL SELECT 'identity', true")
def p9(spark, sf_dir):
    rows = [("flow", al.is_diagonal(t.flow(spark, sf_dir))), ("identity", al.is_diagonal(al.identity(t.part_rows(spark, sf_dir))))]
    return spark.createDataFrame(rows, "name string, diagonal boolean")


@query("P10_identity", with_base("SELECT i, i AS j, 1.0::DOUBLE AS v FROM part_rows"))
def p10(spark, sf_dir):
    return al.identity(t.part_rows(spark, sf_dir))


@query("P10_injector", with_base("SELECT i, row_number() OVER (ORDER BY i) - 1 AS j, 1.0::DOUBLE AS v FROM coarse"))
def p10_injector(spark, sf_dir):
    return al.injector(sets(spark, sf_dir)[1])


@query("P10_masked_identity", with_base("SELECT i, i AS j, CASE WHEN cf = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM cf"))
def p10_masked(spark, sf_dir):
    return al.masked_identity(t.part_rows(spark, sf_dir), sets(spark, sf_dir)[1])


@query("P11_gather", with_base("SELECT x.i, x FROM x JOIN fine f ON f.i = x.i"))
def p11(spark, sf_dir):
    return al.gather(t.part_sizes(spark, sf_dir), sets(spark, sf_dir)[0])


@query("P11_scatter", with_base("SELECT x.i, CASE WHEN cf = 1 THEN -x ELSE x END AS x FROM x JOIN cf ON cf.i = x.i"))
def p11_scatter(spark, sf_dir):
    x = t.part_sizes(spark, sf_dir)
    return al.scatter(x, al.combine(al.gather(x, sets(spark, sf_dir)[1]), alpha=-1.0))


# --- J


@query("J1_spmv", with_base("SELECT A.i, sum(v * x) AS x FROM A JOIN x ON x.i = A.j GROUP BY A.i"))
def j1(spark, sf_dir):
    return al.spmv(t.flow(spark, sf_dir), t.part_sizes(spark, sf_dir))


@query("J2_spgemm", with_base("SELECT a.i, b.j, sum(a.v * b.v) AS v FROM A a JOIN A b ON b.i = a.j GROUP BY 1, 2"))
def j2(spark, sf_dir):
    a = materialize(t.flow(spark, sf_dir), "flow")
    return al.spgemm(a, a)


@query("J3_spgemm_pattern", with_base("SELECT DISTINCT a.i, b.j FROM A a JOIN A b ON b.i = a.j"))
def j3(spark, sf_dir):
    a = t.flow(spark, sf_dir)
    return al.spgemm_pattern(a, a)


_P = "P AS (SELECT i, i AS j, 1.0 AS v FROM coarse UNION ALL SELECT i, j, 1.0 FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS k FROM A WHERE i IN (SELECT i FROM fine) AND j IN (SELECT i FROM coarse)) WHERE k = 1)"


def _prolongator(spark, sf_dir):
    from gossamer.operators import transfer as tr

    fine, coarse = sets(spark, sf_dir)
    return tr.prolongator(al.row_argmax(al.submatrix(t.flow(spark, sf_dir), fine, coarse)), coarse)


@query("J4_triple_product", with_base("SELECT p.j AS i, q.j, sum(p.v * a.v * q.v) AS v FROM P p JOIN A a ON a.i = p.i JOIN P q ON q.i = a.j GROUP BY 1, 2", _P))
def j4(spark, sf_dir):
    return al.triple_product(_prolongator(spark, sf_dir), materialize(t.flow(spark, sf_dir), "flow"))


@query("J5_transpose_product", with_base("SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM A a JOIN A b ON b.i = a.i GROUP BY 1, 2"))
def j5(spark, sf_dir):
    a = materialize(t.flow(spark, sf_dir), "flow")
    return al.transpose_product(a, a)


@query("J6_semi_join", with_base("SELECT A.i, A.j, A.v FROM A JOIN S ON S.i = A.i AND S.j = A.j"))
def j6(spark, sf_dir):
    from gossamer.operators.strength import strength

    a = t.flow(spark, sf_dir)
    return al.restrict_to(a, strength(a, 0.5, symmetrize=False))


@query("J7_merge", with_base("SELECT i FROM A UNION SELECT j FROM A"))
def j7(spark, sf_dir):
    a = t.flow(spark, sf_dir)
    return al.union_sets(a, al.transpose(a))


@query("J8_lookup", with_base("SELECT r.i, A.v AS v FROM part_rows r JOIN A ON A.i = r.i AND A.j = r.i + 1"))
def j8(spark, sf_dir):
    wanted = t.part_rows(spark, sf_dir).select("i", (F.col("i") + 1).alias("j"))
    return al.lookup(t.flow(spark, sf_dir), wanted).select("i", "v")


@query("J9_columns_needed", with_base("SELECT A.i, A.j, x FROM A JOIN x ON x.i = A.j"))
def j9(spark, sf_dir):
    return al.columns_needed(t.flow(spark, sf_dir), t.part_sizes(spark, sf_dir))


@query("J10_rows_needed", with_base("SELECT S.i, S.j AS r, A.j, A.v FROM S JOIN A ON A.i = S.j"))
def j10(spark, sf_dir):
    from gossamer.operators.strength import strength

    a = t.flow(spark, sf_dir)
    return al.rows_needed(a, strength(a, 0.5, symmetrize=False))


@query("J11_anti_join", with_base("SELECT DISTINCT j AS i FROM A WHERE j NOT IN (SELECT i FROM coarse)"))
def j11(spark, sf_dir):
    return al.complement(al.transpose(t.flow(spark, sf_dir)).select("i").distinct(), sets(spark, sf_dir)[1])


# --- A


@query("A1_degrees", with_base("SELECT i, count(*) AS n FROM A GROUP BY i"))
def a1(spark, sf_dir):
    return al.degrees(t.flow(spark, sf_dir))


@query("A2_axpy", with_base("SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT j, i, 2 * v FROM A) GROUP BY i, j"))
def a2(spark, sf_dir):
    a = t.flow(spark, sf_dir)
    return al.axpy(a, 2.0, al.transpose(a))


@query("A3_dominance", with_base("SELECT i, round(ratio, 9) AS ratio FROM ratios"))
def a3(spark, sf_dir):
    return rounded(al.dominance(t.dominant(spark, sf_dir), sets(spark, sf_dir)[0]), 9)


@query("A4_norms", with_base("SELECT round(sqrt(sum(x * x)), 6) AS two, max(abs(x)) AS inf FROM x"))
def a4(spark, sf_dir):
    return rounded(al.norms(t.part_sizes(spark, sf_dir)))


@query("A5_norm_inf", with_base("SELECT max(s) AS inf FROM (SELECT sum(abs(v)) AS s FROM D GROUP BY i)"))
def a5(spark, sf_dir):
    return al.norm_inf(t.dominant(spark, sf_dir))


@query("A6_dots", "SELECT sum(p_size::DOUBLE * p_size) AS own, sum(p_size::DOUBLE * p_partkey) AS ids, sum(p_size::DOUBLE) AS ones FROM part")
def a6(spark, sf_dir):
    x = t.part_sizes(spark, sf_dir)
    return al.dots(x.select("i", "x", F.col("x").alias("own"), F.col("i").cast("double").alias("ids"), F.lit(1.0).alias("ones")), ["own", "ids", "ones"])


@query("A7_combine", with_base("SELECT x.i, 3 * x - 2 * y AS x FROM x JOIN (SELECT A.i, sum(v * x) AS y FROM A JOIN x ON x.i = A.j GROUP BY A.i) t ON t.i = x.i UNION ALL SELECT i, 3 * x FROM x WHERE i NOT IN (SELECT i FROM A)"))
def a7(spark, sf_dir):
    x = t.part_sizes(spark, sf_dir)
    return al.combine(x, (-2.0, al.spmv(t.flow(spark, sf_dir), x)), alpha=3.0)


@query("A8_tsqr", "SELECT round(sqrt(sum(p_size::DOUBLE * p_size)), 6) AS r11, round(sum(p_size::DOUBLE * p_retailprice) / sqrt(sum(p_size::DOUBLE * p_size)), 4) AS r12, round(sqrt(sum(p_retailprice ** 2) - sum(p_size::DOUBLE * p_retailprice) ** 2 / sum(p_size::DOUBLE * p_size)), 4) AS r22 FROM part")
def a8(spark, sf_dir):
    from gossamer.session import prepare, read_table

    r = tsqr(read_table(prepare(spark), sf_dir, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), ["a", "b"])
    return spark.createDataFrame([(round(float(r[0, 0]), 6), round(float(r[0, 1]), 4), round(float(r[1, 1]), 4))], "r11 double, r12 double, r22 double")


@query("A9_locality", with_base("SELECT count(*) FILTER (i % 8 = j % 8) AS local, count(*) FILTER (i % 8 <> j % 8) AS remote, round(count(*) FILTER (i % 8 = j % 8) / count(*) FILTER (i % 8 <> j % 8), 9) AS ratio FROM A"))
def a9(spark, sf_dir):
    return rounded(al.locality(t.flow(spark, sf_dir), 8), 9)


@query("A11_ratio_bins", with_base("SELECT bin, n, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS above FROM (SELECT least(floor(ratio * 1000), 999)::INTEGER AS bin, count(*) AS n FROM ratios GROUP BY 1)"))
def a11(spark, sf_dir):
    return sp.ratio_bins(al.dominance(t.dominant(spark, sf_dir), sets(spark, sf_dir)[0]))


@query("A12_row_argmax", with_base("SELECT i, j, 1.0::DOUBLE AS v FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS k FROM A) WHERE k = 1"))
def a12(spark, sf_dir):
    return al.row_argmax(t.flow(spark, sf_dir))


# --- W


@query("W1_row_bound", with_base("SELECT i, j, v, max(abs(v)) OVER (PARTITION BY i) AS m FROM A"))
def w1(spark, sf_dir):
    return al.row_bound(t.flow(spark, sf_dir))


_BOUND = "bound AS (SELECT max(bin) / 1000.0::DOUBLE AS bound FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM (SELECT least(floor(ratio * 1000), 999) AS bin, count(*) AS n FROM ratios GROUP BY 1)) WHERE above >= (SELECT floor(count(*) * 0.1) FROM ratios))"


@query("W2_top_fraction", with_base("SELECT r.i, round(r.ratio, 9) AS ratio FROM ratios r, bound WHERE ratio <> 0 AND ratio >= bound", _BOUND))
def w2(spark, sf_dir):
    ratios = al.dominance(t.dominant(spark, sf_dir), sets(spark, sf_dir)[0])
    return rounded(ratios.join(F.broadcast(sp.swap_bound(ratios, 0.1)), F.col("ratio") >= F.col("bound")).where("ratio <> 0").select("i", "ratio"), 9)


@query("W3_shuffle", "SELECT p_partkey AS i, row_number() OVER (ORDER BY ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT, p_partkey) - 1 AS k FROM part")
def w3(spark, sf_dir):
    return al.shuffled(t.part_rows(spark, sf_dir))


@query("W4_ordered_set", with_base("SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM (SELECT i FROM coarse UNION SELECT j FROM A WHERE i <= 20 EXCEPT SELECT i FROM x WHERE x = 30)"))
def w4(spark, sf_dir):
    """The coarse rows, with the neighbours of the first twenty rows put in and those of size 30 taken out."""
    more = al.transpose(t.flow(spark, sf_dir).where("i <= 20"))
    return al.OrderedSet(sets(spark, sf_dir)[1]).insert(more).remove(t.part_sizes(spark, sf_dir).where("x = 30")).vector()


@query("W4_ordered_set_bounds", with_base("SELECT min(i) AS low, max(i) AS high, count(*) AS n FROM (SELECT i FROM coarse UNION SELECT i FROM A)"))
def w4_bounds(spark, sf_dir):
    return al.OrderedSet(sets(spark, sf_dir)[1]).insert(t.flow(spark, sf_dir)).bounds()


@query("W5_leja_order", "SELECT * FROM (VALUES (0, 8.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0), (2, 5.0, 2.0), (3, 5.0, -2.0), (4, 3.0, 0.0)) v(k, re, im)")
def w5(spark, sf_dir):
    roots = modified_leja(np.array([1, 3, 5 + 2j, 5 - 2j, 8], complex))
    return spark.createDataFrame([(k, float(z.real), float(z.imag)) for k, z in enumerate(roots)], "k int, re double, im double")


@query("W6_renumber", with_base("SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM coarse"))
def w6(spark, sf_dir):
    return al.renumber(sets(spark, sf_dir)[1])


# --- U


@query("U1_union_pattern", with_base("SELECT i, j FROM A UNION SELECT j, i FROM A"))
def u1(spark, sf_dir):
    a = t.flow(spark, sf_dir)
    return al.union_pattern(a, al.transpose(a))


@query("U2_intersect", with_base("SELECT i FROM A INTERSECT SELECT i FROM coarse"))
def u2(spark, sf_dir):
    return al.intersect_sets(t.flow(spark, sf_dir), sets(spark, sf_dir)[1])


@query("U3_complement", with_base("SELECT i FROM part_rows EXCEPT SELECT i FROM fine"))
def u3(spark, sf_dir):
    return al.complement(t.part_rows(spark, sf_dir), sets(spark, sf_dir)[0])


@query("U4_same_set", "SELECT true AS same, false AS other")
def u4(spark, sf_dir):
    fine, coarse = sets(spark, sf_dir)
    rows = t.part_rows(spark, sf_dir)
    return spark.createDataFrame([(al.same_set(al.complement(rows, fine), coarse), al.same_set(fine, coarse))], "same boolean, other boolean")


@query("I18_start_vector", "SELECT p_partkey AS i, round(sqrt(-2 * ln((('0x' || substr(md5(p_partkey::VARCHAR || 'starta'), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * ('0x' || substr(md5(p_partkey::VARCHAR || 'startb'), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 6) AS x FROM part")
def i18(spark, sf_dir):
    return rounded(start_vector(t.part_rows(spark, sf_dir)))


@query("I1_krylov_powers", with_base("SELECT x.i, x AS x0, coalesce(y, 0.0) AS x1 FROM x LEFT JOIN (SELECT A.i, sum(v * x) AS y FROM A JOIN x ON x.i = A.j GROUP BY A.i) t ON t.i = x.i"))
def i1_powers(spark, sf_dir):
    return powers(materialize(t.flow(spark, sf_dir), "flow"), t.part_sizes(spark, sf_dir), 1)


@query("P5_uniform", "SELECT p_partkey AS i, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM part")
def uniform_vector(spark, sf_dir):
    return t.part_rows(spark, sf_dir).select("i", uniform(F.col("i")).alias("x"))


@query("J1_spmv_grid", "WITH n AS (SELECT r, r % 50 AS i, r // 50 AS j FROM range(2500) t(r)) SELECT r AS i, 4.0::DOUBLE - (i > 0)::INT - (i < 49)::INT - (j > 0)::INT - (j < 49)::INT AS x FROM n")
def j1_grid(spark, sf_dir):
    return al.spmv(g.laplacian_2d(spark, 50), spark.range(2500).select(F.col("id").alias("i"), F.lit(1.0).alias("x")))
