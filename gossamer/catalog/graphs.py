"""Strength of connection and CF splittings (G)."""

from pyspark.sql import functions as F

from gossamer.catalog import query, with_base
from gossamer.catalog.algebra import rounded, sets
from gossamer.catalog.chains import Chain, uniform
from gossamer.operators import algebra as al
from gossamer.operators import luby
from gossamer.operators import splitting as sp
from gossamer.operators.partition import partition_graph
from gossamer.operators.strength import strength
from gossamer.plans.model import InverseOptions, InverseType, SplittingType
from gossamer.session import materialize, prepare
from gossamer.sources import generators as g
from gossamer.sources import tables as t


#: So many rounds assign every node of these matrices.
_ENOUGH = 14


def pattern(spark, sf_dir, **options):
    return strength(t.flow(spark, sf_dir), 0.5, **options)


@query("G1_strength", with_base("SELECT i, j FROM S"))
def g1(spark, sf_dir):
    return pattern(spark, sf_dir, symmetrize=False)


@query("G1_strength_symmetrized", with_base("SELECT i, j FROM SS"))
def g1_symmetrized(spark, sf_dir):
    return pattern(spark, sf_dir)


@query("G1_strength_squared", with_base("SELECT i, j FROM (SELECT a.j AS i, b.j FROM S a JOIN S b ON b.i = a.i UNION SELECT i, j FROM S) WHERE i <> j"))
def g1_squared(spark, sf_dir):
    return pattern(spark, sf_dir, symmetrize=False, square=True)


@query("G1_strength_diagonal", with_base("SELECT i, j FROM (SELECT *, max(CASE WHEN i = j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM D) WHERE i <> j AND abs(v) >= 0.05 * m"))
def g1_diagonal(spark, sf_dir):
    return strength(t.dominant(spark, sf_dir), 0.05, symmetrize=False, diagonal_relative=True)


def _rounds(edges: str, first: str, k: int) -> str:
    """The Luby rounds, unrolled, as chained common table expressions."""
    parts = [f"n0 AS MATERIALIZED ({first})", f"e AS MATERIALIZED ({edges})"]
    for r in range(k):
        parts += [
            f"l{r} AS MATERIALIZED (SELECT DISTINCT e.i FROM e JOIN n{r} a ON a.i = e.i AND NOT a.assigned JOIN n{r} b ON b.i = e.j AND NOT b.assigned WHERE a.m > b.m OR (a.m = b.m AND a.i > b.i))",
            f"w{r} AS MATERIALIZED (SELECT i FROM n{r} WHERE NOT assigned AND i NOT IN (SELECT i FROM l{r}))",
            f"b{r} AS MATERIALIZED (SELECT DISTINCT j AS i FROM e WHERE i IN (SELECT i FROM w{r}))",
            f"n{r + 1} AS MATERIALIZED (SELECT i, m, assigned OR i IN (SELECT i FROM w{r}) OR i IN (SELECT i FROM b{r}) AS assigned, CASE WHEN i IN (SELECT i FROM w{r}) THEN -1 ELSE cf END AS cf FROM n{r})",
        ]
    return ", ".join(parts)


_START = "SELECT r.i, {sign}(coalesce(n, 0) * 4294967296 + ('0x' || substr(md5(r.i::VARCHAR), 1, 8))::BIGINT) AS m, coalesce(n, 0) = 0 AS assigned, CASE WHEN coalesce(n, 0) = 0 THEN {alone} ELSE 0 END AS cf FROM part_rows r LEFT JOIN (SELECT i, count(*) AS n FROM {edges} GROUP BY i) d ON d.i = r.i"


@query("G2_pmisr", with_base("SELECT i, CASE WHEN cf = 0 THEN 1 ELSE cf END::INTEGER AS cf FROM n3", _rounds("SELECT i, j FROM SS", _START.format(sign="", alone=-1, edges="SS"), 3)))
def g2(spark, sf_dir):
    return luby.pmisr(pattern(spark, sf_dir), t.part_rows(spark, sf_dir), max_steps=3)


@query("G2_pmis", with_base("SELECT i, (-CASE WHEN cf = 0 THEN 1 ELSE cf END)::INTEGER AS cf FROM n3", _rounds("SELECT i, j FROM SS", _START.format(sign="-", alone=1, edges="SS"), 3)))
def g2_pmis(spark, sf_dir):
    return luby.pmisr(pattern(spark, sf_dir), t.part_rows(spark, sf_dir), max_steps=3, pmis=True)


@query("G2_pmisr_to_the_end", with_base("SELECT i, CASE WHEN cf = 0 THEN 1 ELSE cf END::INTEGER AS cf FROM n12", _rounds("SELECT i, j FROM SS", _START.format(sign="", alone=-1, edges="SS"), 12)))
def g2_end(spark, sf_dir):
    return luby.pmisr(pattern(spark, sf_dir), t.part_rows(spark, sf_dir))


@query("G3_pmisr_on_sum", with_base("SELECT i, CASE WHEN cf = 0 THEN 1 ELSE cf END::INTEGER AS cf FROM n2", _rounds("SELECT i, j FROM A WHERE i <> j UNION SELECT j, i FROM A WHERE i <> j", "SELECT i, coalesce(CASE WHEN x <= 40 THEN x END, 'infinity'::DOUBLE) AS m, x > 40 AS assigned, CASE WHEN x > 40 THEN 1 ELSE 0 END AS cf FROM x", 2)))
def g3(spark, sf_dir):
    measures = t.part_sizes(spark, sf_dir).select("i", F.when(F.col("x") <= 40, F.col("x")).alias("m"))
    return luby.pmisr_on_sum(t.flow(spark, sf_dir), measures, max_steps=2)


@query("G4_ddc_bound", with_base("SELECT cf.i, CASE WHEN r.ratio >= 0.4 AND r.ratio <> 0 THEN 1 ELSE cf.cf END::INTEGER AS cf FROM cf LEFT JOIN ratios r ON r.i = cf.i"))
def g4_bound(spark, sf_dir):
    return sp.ddc(t.dominant(spark, sf_dir), t.part_markers(spark, sf_dir), -0.4)


_BOUND = "bound AS (SELECT max(bin) / 1000.0::DOUBLE AS bound FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM (SELECT least(floor(ratio * 1000), 999) AS bin, count(*) AS n FROM ratios GROUP BY 1)) WHERE above >= (SELECT floor(count(*) * 0.1) FROM ratios))"


@query("G4_ddc", with_base("SELECT cf.i, CASE WHEN r.ratio >= bound AND r.ratio <> 0 THEN 1 ELSE cf.cf END::INTEGER AS cf FROM bound, cf LEFT JOIN ratios r ON r.i = cf.i", _BOUND))
def g4(spark, sf_dir):
    return sp.ddc(t.dominant(spark, sf_dir), t.part_markers(spark, sf_dir), 0.1)


def _chain_sql(build, body="SELECT i, cf::INTEGER AS cf FROM {}"):
    c = Chain()
    return c.sql(body.format(build(c)))


def _all_fine(c):
    return c.add("SELECT i, -1 AS cf FROM part_rows")


def _dominated(c):
    """The splitting by dominance: so many passes and rounds are more than these matrices need."""
    return c.diag_dom("D", c.pmisr(c.strong("D", 0.5), "part_rows", _ENOUGH), 0.5, 10, 10)


@query("G5_diag_dom", _chain_sql(lambda c: c.diag_dom("D", c.add("SELECT i, cf FROM cf"), 0.4, 10, 10)))
def g5(spark, sf_dir):
    return sp.diag_dom(materialize(t.dominant(spark, sf_dir), "dominant"), t.part_markers(spark, sf_dir), 0.4)


def _split(kind, threshold=0.5, **options):
    def run(spark, sf_dir):
        a = materialize(t.dominant(spark, sf_dir), "dominant")
        return sp.compute_cf_splitting(a, t.part_rows(spark, sf_dir), strong_threshold=threshold, splitting=kind, **options)

    return run


_SD = "SD AS MATERIALIZED (SELECT i, j FROM (SELECT *, max(CASE WHEN i <> j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM D) WHERE i <> j AND abs(v) >= 0.5 * m), SDS AS MATERIALIZED (SELECT i, j FROM SD UNION SELECT j, i FROM SD), SDD AS MATERIALIZED (SELECT i, j FROM (SELECT a.j AS i, b.j FROM SD a JOIN SD b ON b.i = a.i UNION SELECT i, j FROM SD) WHERE i <> j)"


def _to_the_end(edges: str, sign: str, alone: int) -> str:
    return _SD + ", " + _rounds(f"SELECT i, j FROM {edges}", _START.format(sign=sign, alone=alone, edges=edges), _ENOUGH)


_PMIS = f"SELECT i, (-CASE WHEN cf = 0 THEN 1 ELSE cf END)::INTEGER AS cf FROM n{_ENOUGH}"
_DDC = f"""
cf0 AS MATERIALIZED (SELECT i, CASE WHEN cf = 0 THEN 1 ELSE cf END AS cf FROM n{_ENOUGH}),
ratio0 AS MATERIALIZED (SELECT f.i, CASE WHEN own > 0 THEN coalesce(off, 0.0) / own ELSE 0.0 END AS ratio FROM (SELECT i FROM cf0 WHERE cf = -1) f LEFT JOIN
      (SELECT i, sum(CASE WHEN i <> j THEN abs(v) END) AS off, max(CASE WHEN i = j THEN abs(v) END) AS own FROM D
       WHERE i IN (SELECT i FROM cf0 WHERE cf = -1) AND j IN (SELECT i FROM cf0 WHERE cf = -1) GROUP BY i) t USING (i)),
bound0 AS (SELECT max(bin) / 1000.0::DOUBLE AS bound FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM (SELECT least(floor(ratio * 1000), 999) AS bin, count(*) AS n FROM ratio0 GROUP BY 1)) WHERE above >= (SELECT floor(count(*) * 0.1) FROM ratio0))
"""

for _name, _kind, _threshold, _sql in (
    ("G6a_pmisr_ddc", SplittingType.PMISR_DDC, 0.5, with_base("SELECT c.i, CASE WHEN r.ratio >= bound AND r.ratio <> 0 THEN 1 ELSE c.cf END::INTEGER AS cf FROM bound0, cf0 c LEFT JOIN ratio0 r ON r.i = c.i", f"{_to_the_end('SDS', '', -1)}, {_DDC}")),
    ("G6b_diag_dom", SplittingType.DIAG_DOM, 0.5, _chain_sql(_dominated)),
    ("G6c_pmis", SplittingType.PMIS, 0.5, with_base(_PMIS, _to_the_end("SDS", "-", 1))),
    ("G6d_pmis_dist2", SplittingType.PMIS_DIST2, 0.5, with_base(_PMIS, _to_the_end("SDD", "-", 1))),
    ("G6e_agg", SplittingType.AGG, 0.9, _chain_sql(lambda c: c.aggregate(c.strong("D", 0.9), "part_rows", 12))),
):
    query(_name, _sql)(_split(_kind, _threshold))

#: Consecutive ids that lie in one block of a local aggregation.
BLOCK_ROWS = 64


def _pmis_agg(c):
    """Markers of PMIS where a row has neighbours in other blocks, aggregation within blocks for the others."""
    s = c.strong("D", 0.9)
    outside = f"i // {BLOCK_ROWS} <> j // {BLOCK_ROWS}"
    markers = c.add(f"SELECT i, cf FROM {c.pmisr(s, 'part_rows', _ENOUGH, negated=True)} WHERE i IN (SELECT i FROM {s} WHERE {outside})")
    found = c.aggregate(c.add(f"SELECT i, j FROM {s} WHERE NOT ({outside})"), "part_rows", 12, markers)
    return c.add(f"SELECT f.i, coalesce(m.cf, f.cf) AS cf FROM {found} f LEFT JOIN {markers} m ON m.i = f.i")


query("G6f_pmis_agg", _chain_sql(_pmis_agg))(_split(SplittingType.PMIS_AGG, 0.9, block_rows=BLOCK_ROWS))


@query("G6g_cr", _chain_sql(lambda c: c.cr("D", _all_fine(c), 0.7, 8, 10)))
def g6g(spark, sf_dir):
    a = materialize(t.dominant(prepare(spark), sf_dir), "dominant")
    return sp.compute_cf_splitting(a, t.part_rows(spark, sf_dir), strong_threshold=0.7, splitting=SplittingType.CR, cr_inverse=InverseOptions(InverseType.JACOBI))


@query("G7_aggregation", _chain_sql(lambda c: c.aggregate(c.strong("D", 0.9), "part_rows", 12), "SELECT i, cf::INTEGER AS cf, aggregate FROM {}"))
def g7(spark, sf_dir):
    return sp.aggregate(strength(t.dominant(spark, sf_dir), 0.9), t.part_rows(spark, sf_dir))


@query("G8_cr_pass", _chain_sql(lambda c: c.cr("D", _all_fine(c), 0.2, 1, 12, weight="w")))
def g8(spark, sf_dir):
    a = materialize(t.dominant(spark, sf_dir), "dominant")
    cf, _, _ = sp.cr_pass(a, t.part_rows(spark, sf_dir).select("i", F.lit(-1).alias("cf")), 0.2, InverseOptions(InverseType.WJACOBI))
    return cf


@query("G9_diag_dom_submatrix", _chain_sql(_dominated, "SELECT i, j, v FROM D WHERE i IN (SELECT i FROM {0} WHERE cf = -1) AND j IN (SELECT i FROM {0} WHERE cf = -1)"))
def g9(spark, sf_dir):
    return sp.diag_dom_submatrix(materialize(t.dominant(spark, sf_dir), "dominant"), t.part_rows(spark, sf_dir), 0.5)[0]


@query("G10_index_sets", with_base("SELECT 'fine' AS kind, i FROM fine UNION ALL SELECT 'coarse', i FROM coarse"))
def g10(spark, sf_dir):
    fine, coarse = sets(spark, sf_dir)
    return fine.select(F.lit("fine").alias("kind"), "i").unionByName(coarse.select(F.lit("coarse").alias("kind"), "i"))


@query("G11_agglomerate", with_base("SELECT i, j, v FROM A"))
def g11(spark, sf_dir):
    """Rows of a small matrix are dealt to fewer partitions."""
    rows = t.part_rows(spark, sf_dir)
    return al.agglomerate(t.flow(spark, sf_dir), rows.count(), 1000)


def _partition_sql(parts, rounds):
    c = Chain()
    where = c.add(f"SELECT i, floor((row_number() OVER (ORDER BY i) - 1) * {parts} / (SELECT count(*) FROM part_rows))::INTEGER AS part FROM part_rows")
    edges = c.add("SELECT i, j FROM A WHERE i <> j UNION SELECT j, i FROM A WHERE i <> j")
    for k in range(rounds):
        beside = c.add(f"SELECT e.i, w.part, count(*) AS n FROM {edges} e JOIN {where} w ON w.i = e.j GROUP BY 1, 2")
        best = c.add(f"SELECT i, part AS goal, n AS most FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, part) AS r FROM {beside}) WHERE r = 1")
        wants = c.add(f"SELECT w.i, w.part, b.goal FROM {where} w JOIN {best} b ON b.i = w.i LEFT JOIN {beside} o ON o.i = w.i AND o.part = w.part WHERE b.goal <> w.part AND b.most > coalesce(o.n, 0)")
        flows = c.add(f"SELECT part, goal, count(*) AS n FROM {wants} GROUP BY 1, 2")
        share = c.add(f"SELECT f.part, f.goal, least(f.n, g.n) / f.n::DOUBLE AS share FROM {flows} f JOIN {flows} g ON g.part = f.goal AND g.goal = f.part")
        go = c.add(f"SELECT w.i, w.goal FROM {wants} w JOIN {share} s ON s.part = w.part AND s.goal = w.goal WHERE {uniform('w.i', f'go{k}')} < s.share")
        where = c.add(f"SELECT w.i, coalesce(g.goal, w.part) AS part FROM {where} w LEFT JOIN {go} g ON g.i = w.i")
    return c.sql(f"SELECT i, part::INTEGER AS part FROM {where}")


@query("G11_graph_partition", _partition_sql(4, 2))
def g11_graph(spark, sf_dir):
    return partition_graph(t.flow(spark, sf_dir), t.part_rows(spark, sf_dir), 4, rounds=2)


@query("F1_flagship", with_base("SELECT r.i, round(r.ratio, 9) AS ratio, coalesce(n, 0)::BIGINT AS strong FROM ratios r LEFT JOIN (SELECT i, count(*) AS n FROM SS GROUP BY i) d ON d.i = r.i"))
def flagship(spark, sf_dir):
    """Dominance ratio of each fine row and its number of strong neighbours."""
    ratios = al.dominance(t.dominant(spark, sf_dir), sets(spark, sf_dir)[0])
    n = pattern(spark, sf_dir).groupBy("i").agg(F.count("*").alias("strong"))
    return rounded(ratios.join(n, "i", "left").select("i", "ratio", F.coalesce("strong", F.lit(0)).cast("long").alias("strong")), 9)
