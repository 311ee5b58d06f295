"""SQL of iterative operators: their steps, unrolled, as chained common table expressions.

A `Chain` collects expressions and hands out their names.  Matrices are relations (i, j, v), vectors (i, x), sets (i); every
product, sum and round stands in SQL of its own, apart from the DataFrame code that it is compared with.
"""

from __future__ import annotations

from math import comb

from gossamer.catalog import with_base

_RANDOM = "('0x' || substr(md5({i}::VARCHAR || '{salt}'), 1, 8))::BIGINT"


def uniform(i: str, salt: str) -> str:
    return f"({_RANDOM.format(i=i, salt=salt)} / 4294967296.0::DOUBLE)"


class Chain:
    def __init__(self):
        self.parts: list[str] = []

    def add(self, body: str) -> str:
        name = f"q{len(self.parts)}"
        self.parts.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def sql(self, body: str) -> str:
        return with_base(body, ", ".join(self.parts))

    # --- vectors and matrices

    def spmv(self, a: str, x: str, rows: str) -> str:
        return self.add(f"SELECT r.i, coalesce(s, 0.0) AS x FROM {rows} r LEFT JOIN (SELECT a.i, sum(a.v * x.x) AS s FROM {a} a JOIN {x} x ON x.i = a.j GROUP BY a.i) t ON t.i = r.i")

    def combine(self, *terms: tuple[str, str]) -> str:
        """The weighted sum of vectors; weights are SQL."""
        return self.add("SELECT i, sum(x) AS x FROM (" + " UNION ALL ".join(f"SELECT i, {w} * x AS x FROM {v}" for w, v in terms) + ") GROUP BY i")

    def spgemm(self, a: str, b: str, pattern: str | None = None) -> str:
        whole = f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON b.i = a.j GROUP BY 1, 2"
        return self.add(whole if pattern is None else f"SELECT p.i, p.j, coalesce(q.v, 0.0) AS v FROM {pattern} p LEFT JOIN ({whole}) q ON q.i = p.i AND q.j = p.j")

    def block(self, a: str, rows: str, columns: str) -> str:
        return self.add(f"SELECT a.i, a.j, a.v FROM {a} a WHERE a.i IN (SELECT i FROM {rows}) AND a.j IN (SELECT i FROM {columns})")

    def start_vector(self, rows: str, salt: str = "start") -> str:
        first, second = (_RANDOM.format(i="i", salt=salt + c) for c in "ab")
        return self.add(f"SELECT i, sqrt(-2.0 * ln(({first} + 1) / 4294967297.0::DOUBLE)) * cos(2.0 * pi() * ({second} / 4294967296.0::DOUBLE)) AS x FROM {rows}")

    def neumann(self, a: str, rows: str, order: int) -> tuple[str, str, str]:
        """(Neumann inverse on a's pattern, that pattern, the inverse diagonal)."""
        d = self.add(f"SELECT i, 1.0 / v AS d FROM {a} WHERE i = j")
        n = self.add(f"SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, 1.0::DOUBLE AS v FROM {rows} UNION ALL SELECT a.i, a.j, -a.v * d FROM {a} a JOIN {d} d ON d.i = a.i) GROUP BY i, j")
        pattern = self.add(f"SELECT i, j FROM {n} UNION SELECT i, i FROM {rows}")
        terms, last = [f"SELECT i, i AS j, 1.0::DOUBLE AS v FROM {rows}", f"SELECT i, j, v FROM {n}"], n
        for _ in range(order - 1):
            last = self.spgemm(last, n, pattern)
            terms.append(f"SELECT i, j, v FROM {last}")
        return self.add(f"SELECT m.i, m.j, sum(m.v) * any_value(d.d) AS v FROM ({' UNION ALL '.join(terms)}) m JOIN {d} d ON d.i = m.j GROUP BY m.i, m.j"), pattern, d

    def arnoldi(self, a: str, rows: str, order: int) -> tuple[str, str, str]:
        """(the polynomial of the diagonally scaled matrix with the least residual, on a's pattern; that pattern; the inverse diagonal)."""
        d = self.add(f"SELECT i, 1.0 / v AS d FROM {a} WHERE i = j")
        s = self.add(f"SELECT a.i, a.j, a.v * d AS v FROM {a} a JOIN {d} d ON d.i = a.i")
        pattern = self.add(f"SELECT i, j FROM {s} UNION SELECT i, i FROM {rows}")
        plain, _, _ = self.fitted(s, self.start_vector(rows), rows, order)
        terms, last = [f"SELECT i, i AS j, (SELECT c_0 FROM {plain}) AS v FROM {rows}"], s
        for k in range(1, order + 1):
            last = self.spgemm(last, s, pattern) if k > 1 else s
            terms.append(f"SELECT i, j, (SELECT c_{k} FROM {plain}) * v AS v FROM {last}")
        return self.add(f"SELECT m.i, m.j, sum(m.v) * any_value(d.d) AS v FROM ({' UNION ALL '.join(terms)}) m JOIN {d} d ON d.i = m.j GROUP BY m.i, m.j"), pattern, d

    # --- least squares over a few vectors

    def gram(self, vectors: list[str], b: str) -> str:
        """One row: g_p_q and r_p, the products of the vectors with each other and with b, and bb."""
        m = len(vectors)
        sums = [f"sum(y{p}.x * y{q}.x) AS g_{p}_{q}" for p in range(m) for q in range(p, m)] + [f"sum(y{p}.x * b.x) AS r_{p}" for p in range(m)]
        return self.add(f"SELECT {', '.join(sums)}, sum(b.x * b.x) AS bb FROM {b} b " + " ".join(f"JOIN {y} y{p} ON y{p}.i = b.i" for p, y in enumerate(vectors)))

    def eliminate(self, gram: str, m: int) -> list[str]:
        """Rows after each step of elimination; row k has g and r from place k on, and bb less what is explained."""
        steps = [gram]
        for k in range(m - 1):
            g = lambda p, q: f"g_{min(p, q)}_{max(p, q)}"
            kept = [f"g_{p}_{q} - {g(k, p)} * {g(k, q)} / g_{k}_{k} AS g_{p}_{q}" for p in range(k + 1, m) for q in range(p, m)] + [f"r_{p} - {g(k, p)} * r_{k} / g_{k}_{k} AS r_{p}" for p in range(k + 1, m)]
            steps.append(self.add(f"SELECT {', '.join(kept)}, bb - r_{k} * r_{k} / g_{k}_{k} AS bb FROM {steps[-1]}"))
        return steps

    def solve(self, vectors: list[str], b: str) -> str:
        """One row: c_0, ..., the weights of the vectors whose sum is next to b."""
        m = len(vectors)
        steps = self.eliminate(self.gram(vectors, b), m)
        known = ""
        for k in range(m - 1, -1, -1):
            less = "".join(f" - g_{k}_{q} * c_{q}" for q in range(k + 1, m))
            known = self.add(f"SELECT (r_{k}{less}) / g_{k}_{k} AS c_{k}" + "".join(f", c_{q}" for q in range(k + 1, m)) + f" FROM {steps[k]}" + (f", {known}" if known else ""))
        return known

    def fitted(self, a: str, b: str, rows: str, order: int) -> tuple[str, str, str]:
        """(one row c_0, ..., c_order: the polynomial q with the least norm of b - a q(a) b; the same in powers of I - a; b - a q(a) b).

        Fitted over a (I - a)^k b, which are far from parallel for matrices near the identity.
        """
        vectors, n = [], b
        for _ in range(order + 1):
            vectors.append(self.spmv(a, n, rows))
            n = self.combine(("1.0", n), ("-1.0", vectors[-1]))
        row = self.solve(vectors, b)
        plain = self.add("SELECT " + ", ".join(" + ".join(f"{(-1) ** j * comb(k, j)} * c_{k}" for k in range(j, order + 1)) + f" AS c_{j}" for j in range(order + 1)) + f" FROM {row}")
        return plain, row, self.combine(("1.0", b), *((f"(SELECT -c_{k} FROM {row})", v) for k, v in enumerate(vectors)))

    def table(self, row: str, m: int, digits: int) -> str:
        """(k, re, im) of c_0, ..., c_(m - 1)."""
        return " UNION ALL ".join(f"SELECT {k}::INTEGER AS k, round(c_{k}, {digits}) AS re, 0.0::DOUBLE AS im FROM {row}" for k in range(m))

    def roots(self, row: str, m: int, digits: int, steps: int = 60) -> str:
        """(k, re, im): the roots of 1 - c_0 x - ... - c_(m - 1) x^m by simultaneous iteration (Durand and Kerner), in modified Leja order."""
        poly = self.add("SELECT [{'r': 1.0::DOUBLE, 'i': 0.0::DOUBLE}, " + ", ".join(f"{{'r': {f'c_{k - 1} / c_{m - 1}' if k else f'-1.0 / c_{m - 1}'}, 'i': 0.0::DOUBLE}}" for k in range(m - 1, -1, -1)) + f"] AS l FROM {row}")
        z = self.add(" UNION ALL ".join(f"SELECT {k} AS id, {((0.4 + 0.9j) ** k).real}::DOUBLE AS re, {((0.4 + 0.9j) ** k).imag}::DOUBLE AS im" for k in range(m)))
        for _ in range(steps):
            top = f"SELECT z.id, list_reduce(p.l, lambda s, e: {{'r': s.r * z.re - s.i * z.im + e.r, 'i': s.r * z.im + s.i * z.re + e.i}}) AS n FROM {z} z, {poly} p"
            low = f"SELECT z.id, list_reduce(list({{'r': z.re - y.re, 'i': z.im - y.im}}), lambda s, e: {{'r': s.r * e.r - s.i * e.i, 'i': s.r * e.i + s.i * e.r}}) AS d FROM {z} z JOIN {z} y ON y.id <> z.id GROUP BY z.id"
            z = self.add(f"SELECT z.id, z.re - (n.r * d.r + n.i * d.i) / (d.r * d.r + d.i * d.i) AS re, z.im - (n.i * d.r - n.r * d.i) / (d.r * d.r + d.i * d.i) AS im FROM {z} z JOIN ({top}) t ON t.id = z.id JOIN ({low}) b ON b.id = z.id")
        z = self.add(f"SELECT id, re, CASE WHEN abs(im) < 1e-9 THEN 0.0 ELSE im END AS im FROM {z}")
        taken = self.add("SELECT []::INTEGER[] AS taken")
        for k in range(m):
            score = "max(sqrt(r.re * r.re + r.im * r.im))" if not k else "sum(ln(sqrt((r.re - l.re) ** 2 + (r.im - l.im) ** 2)))"
            mate = f"max(CASE WHEN l.id = taken[{k}] AND l.im <> 0 AND abs(l.re - r.re) + abs(l.im + r.im) < 1e-7 THEN 1 ELSE 0 END)" if k else "0"
            taken = self.add(f"SELECT list_append(taken, id) AS taken FROM (SELECT t.taken, r.id, r.re, r.im, {mate} AS mate, {score} AS score FROM {taken} t JOIN {z} r ON NOT list_contains(t.taken, r.id) LEFT JOIN {z} l ON list_contains(t.taken, l.id) GROUP BY ALL) ORDER BY mate DESC, round(score, 9) DESC, im > 0 DESC, re DESC, im DESC LIMIT 1")
        return f"SELECT (list_position(t.taken, z.id) - 1)::INTEGER AS k, round(re, {digits}) AS re, round(im, {digits}) AS im FROM {z} z, {taken} t"

    # --- splittings

    def rounds(self, edges: str, first: str, k: int) -> str:
        """(i, cf) after k Luby rounds over edges (i, j) from `first` (i, m, assigned, cf)."""
        n = self.add(first)
        for _ in range(k):
            loses = f"SELECT e.i FROM {edges} e JOIN {n} a ON a.i = e.i AND NOT a.assigned JOIN {n} b ON b.i = e.j AND NOT b.assigned WHERE a.m > b.m OR (a.m = b.m AND a.i > b.i)"
            wins = self.add(f"SELECT i FROM {n} WHERE NOT assigned AND i NOT IN ({loses})")
            near = f"SELECT j FROM {edges} WHERE i IN (SELECT i FROM {wins})"
            n = self.add(f"SELECT i, m, assigned OR i IN (SELECT i FROM {wins}) OR i IN ({near}) AS assigned, CASE WHEN i IN (SELECT i FROM {wins}) THEN -1 ELSE cf END AS cf FROM {n}")
        return self.add(f"SELECT i, CASE WHEN cf = 0 THEN 1 ELSE cf END AS cf FROM {n}")

    def strong(self, a: str, threshold: float) -> str:
        s = self.add(f"SELECT i, j FROM (SELECT *, max(CASE WHEN i <> j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM {a}) WHERE i <> j AND abs(v) >= {threshold} * m")
        return self.add(f"SELECT i, j FROM {s} UNION SELECT j, i FROM {s}")

    def pmisr(self, edges: str, rows: str, k: int, negated: bool = False) -> str:
        """PMISR, or PMIS (negated)."""
        first = f"SELECT r.i, {'-' if negated else ''}(coalesce(n, 0) * 4294967296 + {_RANDOM.format(i='r.i', salt='')}) AS m, coalesce(n, 0) = 0 AS assigned, CASE WHEN coalesce(n, 0) = 0 THEN {1 if negated else -1} ELSE 0 END AS cf FROM {rows} r LEFT JOIN (SELECT i, count(*) AS n FROM {edges} GROUP BY i) d ON d.i = r.i"
        done = self.rounds(edges, first, k)
        return self.add(f"SELECT i, -cf AS cf FROM {done}") if negated else done

    def ratios(self, a: str, cf: str) -> str:
        fine = self.add(f"SELECT i FROM {cf} WHERE cf = -1")
        return self.add(
            f"SELECT f.i, CASE WHEN own > 0 THEN coalesce(off, 0.0) / own ELSE 0.0 END AS ratio FROM {fine} f LEFT JOIN (SELECT i, sum(CASE WHEN i <> j THEN abs(v) END) AS off, max(CASE WHEN i = j THEN abs(v) END) AS own FROM {a} WHERE i IN (SELECT i FROM {fine}) AND j IN (SELECT i FROM {fine}) GROUP BY i) t ON t.i = f.i"
        )

    def ddc(self, a: str, cf: str, fraction: float) -> str:
        r = self.ratios(a, cf)
        bound = self.add(f"SELECT max(bin) / 1000.0::DOUBLE AS bound FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM (SELECT least(floor(ratio * 1000), 999) AS bin, count(*) AS n FROM {r} GROUP BY 1)) WHERE above >= (SELECT floor(count(*) * {fraction}) FROM {r})")
        return self.add(f"SELECT c.i, CASE WHEN r.ratio >= bound AND r.ratio <> 0 THEN 1 ELSE c.cf END AS cf FROM {bound}, {cf} c LEFT JOIN {r} r ON r.i = c.i")

    def first_of_all(self, reach: str, k: int) -> str:
        """The rows that a pass in the order of ids would choose; reach: (i, k)."""
        chosen = []
        for _ in range(k):
            won = self.add(f"SELECT r.i FROM {reach} r JOIN (SELECT k, min(i) AS least FROM {reach} GROUP BY k) l ON l.k = r.k GROUP BY r.i HAVING min(least) = r.i")
            chosen.append(f"SELECT i FROM {won}")
            reach = self.add(f"SELECT i, k FROM {reach} WHERE i NOT IN (SELECT i FROM {reach} WHERE k IN (SELECT k FROM {reach} WHERE i IN (SELECT i FROM {won})))")
        return self.add(" UNION ALL ".join(chosen))

    def aggregate(self, edges: str, rows: str, k: int, fixed: str | None = None) -> str:
        """(i, cf, aggregate) of the three steps over a symmetric pattern; fixed: (i, cf) of some rows."""
        fixed = fixed or self.add("SELECT 0::BIGINT AS i, 0 AS cf WHERE false")
        free = self.add(f"SELECT i FROM {rows} WHERE i IN (SELECT i FROM {edges}) AND i NOT IN (SELECT i FROM {fixed})")
        may = self.add(f"SELECT i FROM {free} WHERE i NOT IN (SELECT i FROM {edges} WHERE j IN (SELECT i FROM {fixed}))")
        roots = self.first_of_all(self.add(f"SELECT i, j AS k FROM {edges} WHERE i IN (SELECT i FROM {may}) UNION ALL SELECT i, i FROM {may}"), k)
        covered = self.add(f"SELECT i, 1 AS cf, i AS aggregate FROM {roots} UNION ALL SELECT j, -1, i FROM {edges} WHERE i IN (SELECT i FROM {roots})")
        follow = self.add(f"SELECT e.i, -1 AS cf, arg_min(c.aggregate, e.j) AS aggregate FROM {edges} e JOIN {covered} c ON c.i = e.j WHERE e.i IN (SELECT i FROM {free}) AND e.i NOT IN (SELECT i FROM {covered}) GROUP BY e.i")
        left = self.add(f"SELECT i FROM {free} WHERE i NOT IN (SELECT i FROM {covered}) AND i NOT IN (SELECT i FROM {follow})")
        between = self.add(f"SELECT i, j FROM {edges} WHERE i IN (SELECT i FROM {left}) AND j IN (SELECT i FROM {left})")
        remnants = self.first_of_all(self.add(f"SELECT i, least(i, j) || '-' || greatest(i, j) AS k FROM {between} UNION ALL SELECT i, i::VARCHAR FROM {left}"), k)
        return self.add(
            f"SELECT i, -1 AS cf, NULL::BIGINT AS aggregate FROM {rows} WHERE i NOT IN (SELECT i FROM {edges}) UNION ALL SELECT * FROM {covered} UNION ALL SELECT * FROM {follow} UNION ALL SELECT i, cf, NULL FROM {fixed} WHERE i IN (SELECT i FROM {edges})"
            f" UNION ALL SELECT i, 1, i FROM {remnants} UNION ALL SELECT j, -1, min(i) FROM {between} WHERE i IN (SELECT i FROM {remnants}) GROUP BY j"
        )

    def both(self, a: str, rows: str) -> str:
        """Pattern of a + a' within rows, without the diagonal."""
        off = self.add(f"SELECT i, j FROM {a} WHERE i <> j AND i IN (SELECT i FROM {rows}) AND j IN (SELECT i FROM {rows})")
        return self.add(f"SELECT i, j FROM {off} UNION SELECT j, i FROM {off}")

    def chosen(self, cf: str, edges: str, measures: str, k: int) -> str:
        """cf after the independent set of the measured (not null) went to C."""
        first = f"SELECT i, coalesce(m, 'infinity'::DOUBLE) AS m, m IS NULL AS assigned, CASE WHEN m IS NULL THEN 1 ELSE 0 END AS cf FROM {measures}"
        done = self.rounds(edges, first, k)
        return self.add(f"SELECT c.i, CASE WHEN d.cf = -1 THEN 1 ELSE c.cf END AS cf FROM {cf} c LEFT JOIN {done} d ON d.i = c.i")

    def diag_dom(self, a: str, cf: str, threshold: float, passes: int, k: int) -> str:
        for _ in range(passes):
            r = self.ratios(a, cf)
            m = self.add(f"SELECT i, CASE WHEN ratio >= {threshold} THEN greatest(10.0, 2 * (SELECT max(ratio) FROM {r})) - (ratio - {uniform('i', 'dd')} * 1e-10) END AS m FROM {r}")
            cf = self.chosen(cf, self.both(a, r), m, k)
        return cf

    def cr(self, a: str, cf: str, target: float, passes: int, k: int, weight: str = "1.0", sweeps: int = 10) -> str:
        """Compatible relaxation by (weighted) Jacobi; a pass at or below the target rate changes nothing."""
        for _ in range(passes):
            fine = self.add(f"SELECT i FROM {cf} WHERE cf = -1")
            aff = self.block(a, fine, fine)
            w = weight if weight == "1.0" else self.weight(aff)
            m = self.add(f"SELECT i, {w if w == '1.0' else f'(SELECT w FROM {w})'} / v AS v FROM {aff} WHERE i = j")
            first = e = self.add(f"SELECT i, {uniform('i', 'cr')} AS x FROM {fine}")
            for _ in range(sweeps):
                e = self.add(f"SELECT e.i, e.x - m.v * t.s AS x FROM {e} e JOIN {m} m ON m.i = e.i JOIN (SELECT a.i, sum(a.v * e.x) AS s FROM {aff} a JOIN {e} e ON e.i = a.j GROUP BY a.i) t ON t.i = e.i")
            size = self.add(f"SELECT pow((SELECT sqrt(sum(x * x)) FROM {e}) / (SELECT sqrt(sum(x * x)) FROM {first}), 1.0 / {sweeps}) AS rate, (SELECT max(abs(x)) FROM {e}) AS top")
            measure = self.add(f"SELECT i, CASE WHEN rate > {target} AND abs(x) / top >= 0.1 THEN 10.0 - (abs(x) / top - {uniform('i', 'cr')} / 1e10) END AS m FROM {e}, {size}")
            cf = self.chosen(cf, self.both(a, fine), measure, k)
        return cf

    def weight(self, a: str) -> str:
        d = self.add(f"SELECT i, 1.0 / sqrt(abs(v)) AS d FROM {a} WHERE i = j")
        return self.add(f"SELECT 0.75 / max(s) AS w FROM (SELECT a.i, sum(abs(a.v) * p.d * q.d) AS s FROM {a} a JOIN {d} p ON p.i = a.i JOIN {d} q ON q.i = a.j GROUP BY a.i)")

    # --- row solves, by fixed-point iteration on the pattern

    def local_exact(self, a: str, pattern: str, rhs: str, steps: int) -> str:
        """z on the pattern with z a = rhs there: z <- (rhs - z (a - d)) / d.  a is diagonally dominant."""
        d = self.add(f"SELECT i, v AS d FROM {a} WHERE i = j")
        off = self.add(f"SELECT i, j, v FROM {a} WHERE i <> j")
        fixed = self.add(f"SELECT p.i, p.j, coalesce(r.v, 0.0) AS r, d.d FROM {pattern} p JOIN {d} d ON d.i = p.j LEFT JOIN {rhs} r ON r.i = p.i AND r.j = p.j")
        z = self.add(f"SELECT i, j, r / d AS v FROM {fixed}")
        for _ in range(steps):
            z = self.add(f"SELECT f.i, f.j, (f.r - coalesce(s.v, 0.0)) / f.d AS v FROM {fixed} f LEFT JOIN (SELECT z.i, o.j, sum(z.v * o.v) AS v FROM {z} z JOIN {off} o ON o.i = z.j GROUP BY 1, 2) s ON s.i = f.i AND s.j = f.j")
        return z

    def local_least(self, a: str, pattern: str, rhs: str, steps: int) -> str:
        """z on the pattern with the least norm of z a - rhs, from the normal equations: z += (rhs a' - z a a')|pattern / diag(a a')."""
        gram = self.add(f"SELECT p.i, q.i AS j, sum(p.v * q.v) AS v FROM {a} p JOIN {a} q ON q.j = p.j GROUP BY 1, 2")
        wanted = self.add(f"SELECT p.i, p.j, coalesce(sum(r.v * a.v), 0.0) AS f, any_value(g.v) AS d FROM {pattern} p JOIN {gram} g ON g.i = p.j AND g.j = p.j JOIN {a} a ON a.i = p.j LEFT JOIN {rhs} r ON r.i = p.i AND r.j = a.j GROUP BY p.i, p.j")
        terms = self.add(f"SELECT p.i, p.j, q.j AS k, g.v FROM {pattern} p JOIN {pattern} q ON q.i = p.i JOIN {gram} g ON g.i = p.j AND g.j = q.j")
        z = self.add(f"SELECT i, j, f / d AS v FROM {wanted}")
        for _ in range(steps):
            z = self.add(f"SELECT z.i, z.j, z.v + (w.f - s.v) / w.d AS v FROM {z} z JOIN {wanted} w ON w.i = z.i AND w.j = z.j JOIN (SELECT t.i, t.j, sum(t.v * z.v) AS v FROM {terms} t JOIN {z} z ON z.i = t.i AND z.j = t.k GROUP BY 1, 2) s ON s.i = z.i AND s.j = z.j")
        return z


class Level:
    """One level of a hierarchy in SQL: names of its relations."""

    def __init__(self, c: Chain, a: str, rows: str, rounds: int, order: int = 2, strong: float = 0.5, local: int = 0, coarse_limit: int = 6, krylov: bool = False):
        self.c, self.a, self.rows = c, a, rows
        self.cf = c.ddc(a, c.pmisr(c.strong(a, strong), rows, rounds), 0.1)
        self.fine, self.coarse = c.add(f"SELECT i FROM {self.cf} WHERE cf = -1"), c.add(f"SELECT i FROM {self.cf} WHERE cf = 1")
        #: Whether the next level is made.
        self.goes_on = f"(SELECT count(*) FROM {self.coarse}) > {coarse_limit} AND (SELECT count(*) FROM {self.fine}) > 0"
        f, g = self.fine, self.coarse
        self.aff, self.afc, self.acf, self.acc = c.block(a, f, f), c.block(a, f, g), c.block(a, g, f), c.block(a, g, g)
        self.inv, self.pattern, _ = (c.arnoldi if krylov else c.neumann)(self.aff, f, order)
        if local:
            z = c.local_exact(self.aff, local_pattern(c, self.aff, self.acf), c.add(f"SELECT i, j, -v AS v FROM {self.acf}"), local)
        else:
            z = c.add(f"SELECT i, j, -v AS v FROM {c.spgemm(self.acf, self.inv)}")
        z = c.add(f"SELECT i, j, v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM {z}) WHERE abs(v) >= 0.01 * m")
        w = c.add(f"SELECT i, j, 1.0::DOUBLE AS v FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS k FROM {self.afc}) WHERE k = 1")
        self.r, self.p = (c.add(f"SELECT i, j, v FROM {m} UNION ALL SELECT i, i, 1.0 FROM {g}") for m in (z, w))

    def next_matrix(self) -> tuple[str, str]:
        c = self.c
        full = c.spgemm(self.r, c.spgemm(self.a, self.p))
        kept = c.add(f"SELECT i, j, v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS m FROM {full}) WHERE (i = j OR abs(v) >= 1e-4 * m) AND {self.goes_on}")
        return kept, c.add(f"SELECT i FROM {self.coarse} WHERE {self.goes_on}")

    def smooth(self, b: str, x: str, times: int, kind: str = "f", inverse: str = "") -> str:
        c = self.c
        own, inner, outer = (self.fine, self.aff, self.afc) if kind == "f" else (self.coarse, self.acc, self.acf)
        some = lambda v: c.add(f"SELECT i, x FROM {v} WHERE i IN (SELECT i FROM {own})")
        rhs, part = c.combine(("1.0", some(b)), ("-1.0", c.spmv(outer, x, own))), some(x)
        for _ in range(times):
            part = c.combine(("1.0", part), ("1.0", c.spmv(inverse or self.inv, c.combine(("1.0", rhs), ("-1.0", c.spmv(inner, part, own))), own)))
        return c.add(f"SELECT x.i, coalesce(p.x, x.x) AS x FROM {x} x LEFT JOIN {part} p ON p.i = x.i")


def local_pattern(c: Chain, aff: str, acf: str) -> str:
    """Pattern of acf aff and acf."""
    return c.add(f"SELECT DISTINCT a.i, b.j FROM {acf} a JOIN {aff} b ON b.i = a.j UNION SELECT i, j FROM {acf}")


class Cycle:
    """A hierarchy of some levels over the dominant matrix, with Neumann inverses."""

    def __init__(self, c: Chain, n_levels: int, rounds: int = 14, coarse_order: int = 4, schedule: str = "ff", full: bool = False, **options):
        self.c, self.schedule, self.full, self.levels = c, schedule, full, []
        a, rows = c.add("SELECT i, j, v FROM D"), c.add("SELECT i FROM part_rows")
        for _ in range(n_levels - 1):
            self.levels.append(Level(c, a, rows, rounds, **options))
            a, rows = self.levels[-1].next_matrix()
        self.last, self.last_rows, self.coarse_order = a, rows, coarse_order
        self.coarse_d = ""

    def stats(self) -> str:
        """level, n_rows, fine_rows, nnz."""
        every = [(lv.a, lv.rows, f"CASE WHEN {lv.goes_on} THEN (SELECT count(*) FROM {lv.fine}) ELSE 0 END") for lv in self.levels] + [(self.last, self.last_rows, "0")]
        return " UNION ALL ".join(f"SELECT {k}::INTEGER AS level, (SELECT count(*) FROM {rows}) AS n_rows, ({fine})::BIGINT AS fine_rows, (SELECT count(*) FROM {a}) AS nnz WHERE (SELECT count(*) FROM {rows}) > 0" for k, (a, rows, fine) in enumerate(every))

    def prepare(self) -> None:
        if not self.coarse_d:
            self.coarse_d = self.c.add(f"SELECT i, 1.0 / v AS d FROM {self.last} WHERE i = j")
            self.whole = [self.c.neumann(lv.a, lv.rows, 2)[0] for lv in self.levels] if self.full else []
            self.inv_cc = [self.c.neumann(lv.acc, lv.coarse, 2)[0] if "c" in self.schedule else "" for lv in self.levels]

    def apply(self, b: str) -> str:
        """One cycle."""
        self.prepare()
        c, rhs, guesses = self.c, [b], []
        for k, lv in enumerate(self.levels):
            r = rhs[-1]
            if self.full:
                guesses.append(c.spmv(self.whole[k], r, lv.rows))
                r = c.combine(("1.0", r), ("-1.0", c.spmv(lv.a, guesses[-1], lv.rows)))
            rhs.append(c.spmv(lv.r, r, lv.coarse))
        first = x = c.add(f"SELECT r.i, r.x * d.d AS x FROM {rhs[-1]} r JOIN {self.coarse_d} d ON d.i = r.i")
        for _ in range(self.coarse_order):  # x <- D^-1 b + (I - D^-1 A) x
            ax = c.spmv(self.last, x, self.last_rows)
            x = c.combine(("1.0", first), ("1.0", x), ("-1.0", c.add(f"SELECT y.i, y.x * d.d AS x FROM {ax} y JOIN {self.coarse_d} d ON d.i = y.i")))
        for k in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[k]
            x = c.spmv(lv.p, x, lv.rows)
            if self.full:
                x = c.combine(("1.0", x), ("1.0", guesses[k]))
                x = c.combine(("1.0", x), ("1.0", c.spmv(self.whole[k], c.combine(("1.0", rhs[k]), ("-1.0", c.spmv(lv.a, x, lv.rows))), lv.rows)))
                continue
            if self.schedule == "ff":
                x = lv.smooth(rhs[k], x, 2)
            else:
                for kind in self.schedule:
                    x = lv.smooth(rhs[k], x, 1, kind, self.inv_cc[k] if kind == "c" else "")
        return x
