"""DuckDB SQL for the registered queries, built from shared steps."""

from __future__ import annotations

from .. import schema as S
from ..functions.expressions import SHUFFLE_KEY_SQL, highpass
from ..sources.events import PACKETS_SQL

_B0, _POLE = highpass()
_PAD, _W = S.FILTER_PAD, S.WINDOW
_BAD = " OR ".join(f"{k} IS NULL" for k in S.SENSORS)


def _fill(k: str) -> str:
    known = f"CASE WHEN {k} IS NOT NULL THEN {{x}} END"
    out = []
    for side, f, frame in (("p", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("n", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
        out += [f"{f}({known.format(x=v)} IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN {frame}) AS {side}{c}_{k}" for c, v in (("v", k), ("i", "pos"))]
    return ", ".join(out)


def _filter(source: str, out: str, cols=("x", "y", "z")) -> list[tuple[str, str]]:
    """One pass of the high-pass as a convolution with the powers of its pole, cut where they vanish."""
    lag = ", ".join(f"CASE WHEN i = 0 THEN 0 ELSE {_B0!r} * ({k} - lag({k}) OVER (ORDER BY i)) END AS {k}" for k in cols)
    conv = ", ".join(f"sum(b.{k} * pow({_POLE!r}::DOUBLE, a.i - b.i)) AS {k}" for k in cols)
    return [(f"{out}_u", f"SELECT i, {lag} FROM {source}"), (f"{out}_c", f"SELECT a.i, {conv} FROM {out}_u a JOIN {out}_u b ON b.i BETWEEN a.i - 2400 AND a.i GROUP BY a.i"), (out, f"SELECT (SELECT max(i) FROM {out}_c) - i AS i, {', '.join(cols)} FROM {out}_c")]


def _bin(c: str, edges) -> str:
    return " + ".join(f"({c} >= {float(e)!r})::INT" for e in edges)


_HIST = ", ".join(f"(count(*) FILTER (WHERE b_{k} = {b}))::INT AS {k}_{b}" for k, n in S.BINS.items() for b in range(n))
_CDF = ", ".join(f"({' + '.join(f'{k}_{j}' for j in range(b + 1))}) * {S.WEIGHTS[k]}" for k, n in S.BINS.items() for b in range(n - 1))

#: Steps by name; each may use those before it.
STEPS: list[tuple[str, str]] = [
    ("packets", PACKETS_SQL),
    ("motion", f"SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place, lead(counter) OVER (ORDER BY seq) AS c1, lead(ts) OVER (ORDER BY seq) AS t1 FROM packets WHERE register = {S.MOTION_REGISTER}"),
    ("steps", "SELECT *, coalesce((((c1 - counter)::BIGINT % 128) + 128) % 128, 0) AS d FROM motion"),
    ("spread", "SELECT *, unnest(range(0, greatest(d, 1))) AS j FROM steps"),
    ("filled", f"SELECT row_number() OVER (ORDER BY place, j) - 1 AS pos, seq, j > 0 AS inserted, CASE WHEN j > 0 THEN {S.INSERTED_COMMAND}.0 ELSE command END AS command, CASE WHEN j > 0 THEN round(ts + j * (t1 - ts) / d, 4) ELSE ts END AS ts, CASE WHEN j > 0 THEN (counter + j) % 128 ELSE counter END AS counter, CASE WHEN j = 0 THEN folder END AS folder, {', '.join(f'CASE WHEN j = 0 THEN {k} END AS {k}' for k in S.SENSORS)} FROM spread"),
    ("kept", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, * EXCLUDE (pos, n, bad) FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE {_BAD}) OVER w AS bad FROM filled WINDOW w AS (PARTITION BY pos // {_W})) WHERE n = {_W} AND 100.0 * bad / {_W} <= {S.MAX_LOSS_PERCENT}"),
    ("near", f"SELECT *, last_value(folder IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own_folder, {', '.join(_fill(k) for k in S.SENSORS)} FROM kept"),
    ("clean", "SELECT pos, seq, inserted, ts, counter, own_folder AS folder, " + ", ".join(f"round_even(CASE WHEN {k} IS NOT NULL THEN {k} WHEN pv_{k} IS NULL THEN NULL WHEN nv_{k} IS NULL THEN pv_{k} ELSE pv_{k} + (nv_{k} - pv_{k}) * (pos - pi_{k}) / (ni_{k} - pi_{k}) END, 0) AS {k}" for k in S.SENSORS) + " FROM near"),
    ("scaled", f"SELECT pos, ts, folder, ax * {S.ACC_RANGE} / {S.ADC} AS x, -ay * {S.ACC_RANGE} / {S.ADC} AS y, az * {S.ACC_RANGE} / {S.ADC} AS z, gz * {S.GYRO_RANGE} / {S.ADC} AS z_gyro FROM clean"),
    ("med", f"SELECT pos, ts, folder, {', '.join(f'median({k}) OVER w AS {k}' for k in ('x', 'y', 'z', 'z_gyro'))} FROM scaled WINDOW w AS (ORDER BY pos ROWS BETWEEN {S.MEDIAN_REACH} PRECEDING AND {S.MEDIAN_REACH} FOLLOWING)"),
    ("ends", "SELECT max(pos) AS last FROM med"),
    ("ext", f"SELECT pos + {_PAD} AS i, x, y, z FROM med UNION ALL SELECT {_PAD} - m.pos, 2 * f.x - m.x, 2 * f.y - m.y, 2 * f.z - m.z FROM med m, med f WHERE f.pos = 0 AND m.pos BETWEEN 1 AND {_PAD} UNION ALL SELECT 2 * last + {_PAD} - m.pos, 2 * f.x - m.x, 2 * f.y - m.y, 2 * f.z - m.z FROM ends, med m, med f WHERE f.pos = last AND m.pos BETWEEN last - {_PAD} AND last - 1"),
    *_filter("ext", "fwd"),
    *_filter("fwd", "bwd"),
    ("signals", f"SELECT m.pos, m.ts, m.folder, m.y - b.y AS y_ga, m.z, m.z_gyro, sqrt(b.x * b.x + b.y * b.y + b.z * b.z) AS tot_accel FROM med m JOIN bwd b ON b.i = m.pos + {_PAD}"),
    ("win", f"SELECT *, pos // {_W} AS win, pos % {_W} AS place, ln(greatest(tot_accel, {S.LOG_FLOOR!r})) AS log_tot FROM signals"),
    ("binned", "SELECT win, " + ", ".join(f"{_bin(k, e)} AS b_{k}" for k, e in S.EDGES.items()) + " FROM win"),
    ("hist", f"SELECT win, {_HIST} FROM binned GROUP BY win HAVING count(*) = {_W}"),
    ("cdf", f"SELECT win, [{_CDF}] AS vec FROM hist"),
    ("reps", f"SELECT win, max(ts) FILTER (WHERE place = 0) AS ts_start, max(ts) FILTER (WHERE place = {_W // 2}) AS ts_mid, max(folder) FILTER (WHERE place = 0) AS folder FROM win GROUP BY win HAVING count(*) = {_W}"),
    ("ex", "SELECT win // 16 AS pos, vec FROM cdf WHERE win % 16 = 0"),
    ("to_ex", "SELECT c.win, e.pos, list_sum(list_transform(list_zip(c.vec, e.vec), lambda p: abs(p[1] - p[2])))::BIGINT AS d FROM cdf c, ex e"),
    ("labelled", "SELECT win, arg_min(pos, (d, pos))::INT AS label, min(d) AS d FROM to_ex GROUP BY win"),
    ("seq_labels", "SELECT l.win, CASE WHEN l.d > 500 THEN -1 ELSE l.label END AS label, r.folder FROM labelled l JOIN reps r USING (win)"),
    ("emb", "SELECT vec_id AS win, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::INT) AS vec, label::INT AS label FROM embeddings"),
    ("emb_d", "SELECT a.win AS i, b.win AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))::BIGINT AS d FROM emb a, emb b"),
    ("emb_ex", "SELECT i AS win, arg_min(j, (d, j)) AS pos, min(d) AS d FROM emb_d WHERE j < 8 GROUP BY i"),
    ("ab", "SELECT e.win, CASE WHEN x.win % 13 = 5 THEN -1 ELSE x.pos::INT END AS a, e.label AS b FROM emb e JOIN emb_ex x USING (win)"),
]
_NAMES = [n for n, _ in STEPS]


def sql(query: str, upto: str) -> str:
    """query over the steps up to and including the one named (each is a CTE; unused ones cost nothing)."""
    import re

    steps = dict(STEPS[: _NAMES.index(upto) + 1])
    need, todo = set(), [upto, *(n for n in steps if re.search(rf"\b{n}\b", query))]
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in steps if m != n and re.search(rf"(?:FROM|JOIN|,) {m}\b", steps[n])]
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in _NAMES if n in need) + "\n" + query


def order_key(x: str, seed: int) -> str:
    return SHUFFLE_KEY_SQL.format(x=x, seed=seed)


_KEEP, _NEW = 0.9, 1 - 0.9  # damping


def affinity(points: str, preference: str, unit: float = S.UNIT) -> str:
    """CTEs up to ap_labels (i, label from 0, exemplar; none: -1): dense affinity propagation on points (win, vec; distances in `unit`) with a preference.

    One row for each pair of points and iteration; the run ends when each point's being an exemplar or not held for 15 iterations.
    """
    return f"""ap_d AS (SELECT a.win AS i, b.win AS k, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))) / {unit} AS d FROM {points} a, {points} b),
ap_pref AS (SELECT ({preference}) AS pref),
ap(i, k, s, a, r, e, streak, it, stop) AS (
  SELECT i, k, CASE WHEN i = k THEN pref ELSE -d * d END, 0.0::DOUBLE, 0.0::DOUBLE, false, 0, -1, false FROM ap_d, ap_pref
  UNION ALL
  SELECT i, k, s, a, r, e, streak, it, it >= 15 AND bool_and(streak >= 15 OR i <> k) OVER () AND bool_or(e) OVER () FROM (
    SELECT i, k, s, a, r, i = k AND a + r > 0 AS e, CASE WHEN (i = k AND a + r > 0) = e THEN streak + 1 ELSE 1 END AS streak, it FROM (
      SELECT i, k, s, {_KEEP} * a + {_NEW!r} * CASE WHEN i = k THEN sums - r ELSE least(0, sums - up) END AS a, r, e, streak, it FROM (
        SELECT *, sum(up) OVER (PARTITION BY k) AS sums FROM (
          SELECT i, k, s, a, r, e, streak, it, CASE WHEN i = k THEN r ELSE greatest(r, 0) END AS up FROM (
            SELECT i, k, s, a, {_KEEP} * r + {_NEW!r} * (s - CASE WHEN rn = 1 THEN second ELSE first END) AS r, e, streak, it FROM (
              SELECT *, max(t) OVER (PARTITION BY i) AS first, max(CASE WHEN rn > 1 THEN t END) OVER (PARTITION BY i) AS second FROM (
                SELECT *, row_number() OVER (PARTITION BY i ORDER BY t DESC, k) AS rn FROM (SELECT i, k, s, a, r, e, streak, it + 1 AS it, a + s AS t FROM ap WHERE NOT stop AND it < 999)
              )
            )
          )
        )
      )
    )
  )
),
ap_end AS (SELECT i, k, s, e FROM ap WHERE it = (SELECT max(it) FROM ap)),
ap_found AS (SELECT k AS x FROM ap_end WHERE i = k AND e),
ap_first AS (SELECT i, arg_min(k, (CASE WHEN i = k THEN 0 ELSE 1 END, -s, k)) AS c FROM ap_end WHERE k IN (SELECT x FROM ap_found) GROUP BY i),
ap_centre AS (SELECT c, arg_min(k, (-inside, k)) AS x FROM (SELECT p.c, q.k, sum(q.s) AS inside FROM ap_first p JOIN ap_end q ON q.i = p.i JOIN ap_first m ON m.i = q.k AND m.c = p.c GROUP BY p.c, q.k) GROUP BY c),
ap_rank AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS label FROM ap_centre),
ap_labels AS (
  SELECT i, label::INT AS label, x AS exemplar FROM (SELECT i, arg_min(k, (CASE WHEN i = k THEN 0 ELSE 1 END, -s, k)) AS x FROM ap_end WHERE k IN (SELECT x FROM ap_rank) GROUP BY i) JOIN ap_rank USING (x)
  UNION ALL SELECT i, -1, -1 FROM ap_end WHERE i = k AND NOT EXISTS (SELECT 1 FROM ap_found)
)"""


#: The least similarity of the windows' vectors: exact, and that of half a million random pairs.
LEAST = f"SELECT -pow(max(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))) / {S.UNIT}, 2) FROM cdf a, cdf b"
SAMPLED = f"""SELECT -pow(max(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: abs(p[1] - p[2])))) / {S.UNIT}, 2) FROM (
  SELECT DISTINCT a, CASE WHEN a = b THEN (b + 1) % n ELSE b END AS b FROM (SELECT {order_key('id', 42)} % n AS a, {order_key('id', 43)} % n AS b, n FROM (SELECT unnest(range(500000)) AS id), (SELECT count(*) AS n FROM cdf))
) JOIN cdf_at x ON x.p = a JOIN cdf_at y ON y.p = b"""
AT = "cdf_at AS (SELECT row_number() OVER (ORDER BY win) - 1 AS p, win, vec FROM cdf)"


def recursive(steps: str, query: str, upto: str = "cdf") -> str:
    """query over the steps up to one and further CTEs, some of them recursive."""
    return sql("", upto).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + steps + "\n" + query


def nearest_to(exemplars: str) -> str:
    """CTEs up to near_labels (win, label): the nearest of exemplars (pos, win), ties by the lowest position; none: 0."""
    return f"""near_ex AS (SELECT pos, vec FROM ({exemplars}) JOIN cdf USING (win)),
near_labels AS (SELECT c.win, coalesce(arg_min(e.pos, (list_sum(list_transform(list_zip(c.vec, e.vec), lambda p: abs(p[1] - p[2]))), e.pos)), 0)::INT AS label FROM cdf c LEFT JOIN near_ex e ON true GROUP BY c.win)"""


def sampled_affinity(sample: str, size: int) -> str:
    """Affinity propagation on a sample (a CTE named ap_sample), all windows to its exemplars; on all windows if these are `size` or fewer."""
    small = f"(SELECT count(*) FROM cdf) <= {size}"
    steps = f"{AT}, {sample}, {affinity('ap_sample', f'CASE WHEN {small} THEN ({LEAST}) ELSE ({SAMPLED}) END')}, {nearest_to('SELECT DISTINCT label AS pos, exemplar AS win FROM ap_labels WHERE label >= 0')}"
    return recursive(steps, f"SELECT win, CASE WHEN {small} THEN a.label ELSE n.label END AS label FROM near_labels n LEFT JOIN ap_labels a ON a.i = n.win")


def sparse_affinity(k: int) -> str:
    """Affinity propagation along the mutual graph of the k nearest neighbours; all windows to its exemplars."""
    return recursive(f"""{AT}, sp_pref AS (SELECT ({SAMPLED}) AS pref),
sp_d AS (SELECT a.win AS i, b.win AS k, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))) / {S.UNIT} AS d FROM cdf a JOIN cdf b ON a.win <> b.win),
sp_near AS (SELECT i, k, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS rank FROM sp_d) WHERE rank <= {k}),
sp(i, k, s, a, r, e, since, it, stop) AS (
  SELECT x.i, x.k, -x.d * x.d, 0.0::DOUBLE, 0.0::DOUBLE, false, 0, -1, false FROM sp_near x JOIN sp_near y ON x.i = y.k AND x.k = y.i WHERE x.d <> 0
  UNION ALL (SELECT win, win, pref, 0.0::DOUBLE, 0.0::DOUBLE, false, 0, -1, false FROM cdf, sp_pref)
  UNION ALL
  SELECT i, k, s, a, r, e, since, it, since >= 15 AND bool_or(e) OVER () FROM (
    SELECT i, k, s, a, r, e, CASE WHEN it > 0 AND bool_and(e = was) OVER () THEN since + 1 ELSE 0 END AS since, it FROM (
      SELECT i, k, s, a, r, i = k AND a + r > 0 AS e, e AS was, since, it FROM (
        SELECT i, k, s, {_KEEP} * a + {_NEW!r} * CASE WHEN i = k THEN sums - r ELSE least(0, sums - greatest(r, 0)) END AS a, r, e, since, it FROM (
          SELECT *, sum(CASE WHEN i = k THEN r ELSE greatest(r, 0) END) OVER (PARTITION BY k) AS sums FROM (
            SELECT i, k, s, a, {_KEEP} * r + {_NEW!r} * CASE WHEN high AND many = 1 THEN coalesce(s - rest, 0) ELSE s - top END AS r, e, since, it FROM (
              SELECT *, sum(high::INT) OVER (PARTITION BY i) AS many, max(CASE WHEN NOT high THEN t END) OVER (PARTITION BY i) AS rest FROM (
                SELECT *, t >= top - 1e-14 AS high FROM (SELECT i, k, s, a, r, e, since, it + 1 AS it, a + s AS t, max(a + s) OVER (PARTITION BY i) AS top FROM sp WHERE NOT stop AND it < 999)
              )
            )
          )
        )
      )
    )
  )
),
{nearest_to("SELECT row_number() OVER (ORDER BY k) - 1 AS pos, k AS win FROM sp WHERE it = (SELECT max(it) FROM sp) AND i = k AND e")}""", "SELECT * FROM near_labels")


def density(points: str, least: int) -> str:
    """CTEs up to db_labels (win, label; noise: -1): HDBSCAN of points (win, vec) with clusters of `least` rows or more.

    The tree is grown row by row, its edges are merged one by one; the condensed tree comes from the last merge downwards, the choice
    of clusters from the first upwards. Clusters go by the merge that they begin with.
    """
    k = max(1, least // 5)
    core = f"SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM db_d WHERE i <> j) WHERE rank = {k - 1}" if k > 1 else "SELECT x AS i, 0 AS core FROM db_points"
    return f"""db_points AS (SELECT win, vec, row_number() OVER (ORDER BY win) - 1 AS x FROM {points}),
db_d AS (SELECT a.x AS i, b.x AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))::DOUBLE AS d FROM db_points a, db_points b),
db_core AS ({core}),
db_w AS (SELECT i, j, greatest(d, a.core, b.core) AS w FROM db_d JOIN db_core a USING (i) JOIN db_core b ON b.i = db_d.j),
db_n AS (SELECT count(*) AS n FROM db_points),
db_grow(step, x, inside, e, here) AS (
  SELECT 0, x, x = 0, {{'w': 'infinity'::DOUBLE, 'lo': 0::BIGINT, 'hi': 0::BIGINT}}, 0::BIGINT FROM db_points
  UNION ALL
  SELECT step, x, inside OR x = here, e, here FROM (
    SELECT step, x, inside, e, arg_min(x, e) FILTER (WHERE NOT inside) OVER () AS here FROM (
      SELECT step + 1 AS step, x, inside, CASE WHEN inside THEN e ELSE least(e, {{'w': w, 'lo': least(here, x), 'hi': greatest(here, x)}}) END AS e
      FROM db_grow JOIN db_w ON db_w.i = here AND db_w.j = x, db_n WHERE step < n - 1
    )
  )
),
db_edges AS (SELECT row_number() OVER (ORDER BY e) - 1 AS m, e.w AS w, e.lo AS lo, e.hi AS hi FROM db_grow WHERE step > 0 AND x = here),
db_merge(m, x, own, was, l, r) AS (
  SELECT -1::BIGINT, x, x, x, -1::BIGINT, -1::BIGINT FROM db_points
  UNION ALL
  SELECT m, x, CASE WHEN own IN (l, r) THEN n + m ELSE own END, own, l, r FROM (
    SELECT e.m, s.x, s.own, max(CASE WHEN s.x = e.lo THEN s.own END) OVER () AS l, max(CASE WHEN s.x = e.hi THEN s.own END) OVER () AS r
    FROM db_merge s JOIN db_edges e ON e.m = s.m + 1
  ), db_n
),
db_nodes AS (SELECT n + m AS v, any_value(l) AS l, any_value(r) AS r, count(*) FILTER (WHERE was = l) AS nl, count(*) FILTER (WHERE was = r) AS nr FROM db_merge, db_n WHERE m >= 0 AND own = n + m GROUP BY n, m),
db_rates AS (SELECT v, l, r, nl, nr, CASE WHEN w > 0 THEN 1 / w ELSE 'infinity'::DOUBLE END AS rate FROM db_nodes JOIN db_edges ON v = (SELECT n FROM db_n) + m),
db_tree(v, c, born) AS (
  SELECT max(v), max(v), 0.0::DOUBLE FROM db_rates
  UNION ALL
  SELECT u, CASE WHEN nl >= {least} AND nr >= {least} THEN u ELSE c END, CASE WHEN nl >= {least} AND nr >= {least} THEN rate ELSE born END
  FROM (SELECT t.c, t.born, x.*, unnest([l, r]) AS u, unnest([nl, nr]) AS nu FROM db_tree t JOIN db_rates x USING (v)), db_n WHERE nu >= {least} AND u >= n
),
db_events AS (SELECT t.c, t.born, rate, nl >= {least} AND nr >= {least} AS split, unnest([l, r]) AS u, unnest([nl, nr]) AS nu FROM db_tree t JOIN db_rates USING (v)),
db_finite AS (SELECT coalesce(max(rate) FILTER (WHERE rate < 'infinity'::DOUBLE AND NOT split AND nu < {least}), 1.0) AS top FROM db_events),
db_own AS (SELECT c, coalesce(sum((least(rate, top) - least(born, top)) * nu) FILTER (WHERE split OR nu < {least}), 0) AS own, coalesce(list(u) FILTER (WHERE split), []) AS kids FROM db_events, db_finite GROUP BY c),
db_order AS (SELECT *, row_number() OVER (ORDER BY c) AS k FROM db_own),
db_best(k, c, best, flags) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::DOUBLE[], []::BOOLEAN[]
  UNION ALL
  SELECT k, c, list_append(best, CASE WHEN flag THEN own ELSE below END), list_append(flags, flag) FROM (
    SELECT o.k, list_append(b.c, o.c) AS c, best, flags, own, below, o.c < (SELECT max(c) FROM db_order) AND (len(kids) = 0 OR own >= below) AS flag FROM (
      SELECT o.*, coalesce(list_sum(list_transform(o.kids, lambda x: b.best[list_position(b.c, x)])), 0) AS below FROM db_best b JOIN db_order o ON o.k = b.k + 1
    ) o JOIN db_best b ON o.k = b.k + 1
  )
),
db_flags AS (SELECT unnest(c) AS c, unnest(flags) AS flag FROM db_best WHERE k = (SELECT max(k) FROM db_order)),
db_down(c, flag) AS (
  SELECT c, flag FROM db_flags WHERE c = (SELECT max(c) FROM db_flags)
  UNION ALL
  SELECT f.c, f.flag FROM db_down d JOIN db_own o ON o.c = d.c JOIN db_flags f ON list_contains(o.kids, f.c) WHERE NOT d.flag
),
db_members AS (SELECT s.x, s.own AS c FROM db_merge s, db_n WHERE s.own = n + s.m AND s.own IN (SELECT c FROM db_down WHERE flag)),
db_rank AS (SELECT c, row_number() OVER (ORDER BY min(x)) - 1 AS label FROM db_members GROUP BY c),
db_labels AS (SELECT p.win, coalesce(label, -1)::INT AS label FROM db_points p LEFT JOIN (db_members JOIN db_rank USING (c)) USING (x))"""
