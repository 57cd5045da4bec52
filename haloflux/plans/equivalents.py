"""SQL that states the same results as the registered queries, for another engine.

Each statement works on long tables with plain joins and windows and shares no code with
the operators.
"""

from __future__ import annotations

import math

# -- inputs ---------------------------------------------------------------------------

_TEF = """
tef AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ocean_time,
         CAST(l_suppkey % 4 AS INTEGER) AS cv_id,
         CASE l_linenumber % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'N' END AS face,
         CASE WHEN l_linenumber % 4 IN (0, 2) THEN 1.0e0 ELSE -1.0e0 END AS sgn,
         l_quantity * 0.75e0 AS salt,
         (l_partkey % 160) / 4.0e0 AS temp,
         -((l_partkey % 260) / 4.0e0) AS z,
         ((l_orderkey % 17) - 8) / 8.0e0 * (16 + l_partkey % 64) AS q,
         1024.0e0 * (1 + l_suppkey % 8) AS dv
  FROM lineitem
),
tefb AS (
  SELECT *, salt * q AS qs, salt * salt * q AS qss,
         CAST(CASE WHEN salt BETWEEN 0 AND 40 THEN least(floor(salt / 0.5e0), 79) END AS INTEGER) AS salt_idx,
         CAST(CASE WHEN temp BETWEEN 0 AND 40 THEN least(floor(temp), 39) END AS INTEGER) AS temp_idx,
         CAST(CASE WHEN z BETWEEN -65 AND 0 THEN least(floor((z + 65) / 1.25e0), 51) END AS INTEGER) AS depth_idx
  FROM tef
)
"""

_TEFVAR = (
    _TEF
    + """,
sb AS (SELECT cv_id, ocean_time, sum(salt * dv) / sum(dv) AS sbar FROM tef GROUP BY ALL),
tefv AS (
  SELECT t.*, q * ((salt - sbar) * (salt - sbar)) AS qsvar
  FROM tefb t JOIN sb USING (cv_id, ocean_time)
)
"""
)

# the grid has m times as many rows and columns for m * m times the line items
_GRID = """
refined AS (SELECT CAST(greatest(1, floor(sqrt(count(*) // 37500))) AS BIGINT) AS m FROM lineitem),
g0 AS (
  SELECT CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS t, l_linenumber - 1 AS k,
         l_suppkey % (6 * m) AS j, l_partkey % (8 * m) AS i, count(*) AS n, sum(l_quantity) AS sq,
         sum(l_suppkey) AS ss, sum(l_partkey) AS sp, sum(l_orderkey) AS so
  FROM lineitem, refined GROUP BY ALL
),
cell AS (
  SELECT t, k, j, i, floor(sq * 0.75e0 / n * 64) / 64 AS salt, ((ss + sp) % 160) / 4.0e0 AS temp,
         (n % 8) / 1024.0e0 AS aks, (so % 17 - 8) / 8.0e0 AS u, (sp % 17 - 8) / 8.0e0 AS v
  FROM g0
),
col AS (
  SELECT t, j, i, 16.0e0 + 8 * (j // m) + 4 * (i // m) AS h, 1.0e0 / (512 * (1 + i % 2)) AS pm, 1.0e0 / (512 * (1 + j % 2)) AS pn,
         (sum(ss) % 9 - 4) / 16.0e0 AS zeta, (sum(so) % 9 - 4) / 1024.0e0 AS ssflux, (sum(sp) % 17 - 8) / 8.0e0 AS swflux
  FROM g0, refined GROUP BY t, j, i, m
),
lev AS (
  SELECT c.*, r.k, c.zeta + (c.zeta + c.h) * (r.k / 8.0e0 - 0.8125e0) AS z_rho,
         (c.zeta + c.h) / 8.0e0 AS dz, (c.zeta + c.h) / 8.0e0 / pm / pn AS dv,
         e.salt, e.temp, e.aks, e.u, e.v
  FROM col c CROSS JOIN (SELECT unnest(range(7)) AS k) r
  LEFT JOIN cell e ON e.t = c.t AND e.j = c.j AND e.i = c.i AND e.k = r.k
),
stat AS (SELECT DISTINCT j, i, h, pm, pn FROM col)
"""

# dissipation at interfaces 0..7, then at centres
_CHI = (
    _GRID
    + """,
chiw AS (
  SELECT t, j, i, k, 2 * aks * power((salt - lag(salt) OVER w) / (z_rho - lag(z_rho) OVER w), 2) AS cw, salt
  FROM lev WINDOW w AS (PARTITION BY t, j, i ORDER BY k)
),
chic AS (
  SELECT t, j, i, k,
         CASE WHEN k = 0 THEN CASE WHEN salt IS NOT NULL THEN 0 END ELSE cw END AS lower_w,
         CASE WHEN k = 6 THEN CASE WHEN salt IS NOT NULL THEN 0 END
              ELSE lead(cw) OVER (PARTITION BY t, j, i ORDER BY k) END AS upper_w
  FROM chiw
),
levc AS (
  SELECT l.*, (c.lower_w + c.upper_w) / 2 AS chi,
         CAST(CASE WHEN salt BETWEEN 0 AND 40 THEN least(floor(salt / 0.5e0), 79) END AS INTEGER) AS salt_idx,
         CAST(CASE WHEN temp BETWEEN 0 AND 40 THEN least(floor(temp), 39) END AS INTEGER) AS temp_idx,
         CAST(CASE WHEN z_rho BETWEEN -65 AND 0 THEN least(floor((z_rho + 65) / 1.25e0), 51) END AS INTEGER) AS depth_idx
  FROM lev l JOIN chic c USING (t, j, i, k)
)
"""
)

# id, closed cell range, east line, north line
_BOX = "(0, 2, 5, 2, 4, 5, 4)"
_HALF = "(1, 2, 5, 2, 4, 4, 3)"
_SPLIT = "(0, 2, 3, 2, 2, 3, 2), (1, 2, 3, 3, 4, 3, 4), (2, 4, 5, 2, 2, 5, 2), (3, 4, 5, 3, 4, 5, 4)"


def _cv(rows: str) -> str:
    return f"""cv AS (
  SELECT cv_id, i0 * m AS i0, (i1 + 1) * m - 1 AS i1, j0 * m AS j0, (j1 + 1) * m - 1 AS j1,
         (i1 + 1) * m - 1 + ie - i1 AS ie, (j1 + 1) * m - 1 + jn - j1 AS jn
  FROM (VALUES {rows}) b(cv_id, i0, i1, j0, j1, ie, jn), refined)"""


_FACES = """
pairs AS (
  SELECT cv.cv_id, 'W' AS face, j AS pos, a.j AS j, cv.i0 - 1 AS i, cv.j0 AS lo, cv.j1 AS hi, 'x' AS ax FROM cv, (SELECT DISTINCT j FROM col) a WHERE j BETWEEN j0 AND j1
  UNION ALL SELECT cv_id, 'E', j, j, ie, j0, j1, 'x' FROM cv, (SELECT DISTINCT j FROM col) WHERE j BETWEEN j0 AND j1
  UNION ALL SELECT cv_id, 'S', i, j0 - 1, i, i0, i1, 'y' FROM cv, (SELECT DISTINCT i FROM col) WHERE i BETWEEN i0 AND i1
  UNION ALL SELECT cv_id, 'N', i, jn, i, i0, i1, 'y' FROM cv, (SELECT DISTINCT i FROM col) WHERE i BETWEEN i0 AND i1
),
tk AS (SELECT DISTINCT t, pairs.*, r.k FROM (SELECT DISTINCT t FROM col) x, pairs, (SELECT unnest(range(7)) AS k) r),
fs0 AS (
  SELECT p.cv_id, p.t AS ocean_time, p.face, CAST(p.k AS INTEGER) AS k, CAST(p.pos AS INTEGER) AS pos,
         CASE WHEN ax = 'x' THEN a.u ELSE a.v END AS vel,
         (a.dz + b.dz) / 2 * (CASE WHEN ax = 'x' THEN 2 / (a.pn + b.pn) ELSE 2 / (a.pm + b.pm) END) AS area,
         (a.dz + b.dz) / 2 * (2 / (a.pn + b.pn)) * (2 / (a.pm + b.pm)) AS dv,
         (a.z_rho + b.z_rho) / 2 AS z, (a.salt + b.salt) / 2 AS salt, (a.temp + b.temp) / 2 AS temp,
         1.5e0 * b.salt - 0.5e0 * c.salt AS salt_out, 1.5e0 * b.temp - 0.5e0 * c.temp AS temp_out,
         CASE WHEN p.face IN ('W', 'S') THEN 1.0e0 ELSE -1.0e0 END AS sgn,
         a.t IS NULL AND b.t IS NULL AS absent, c.t IS NULL AS absent2
  FROM tk p
  LEFT JOIN lev a ON a.t = p.t AND a.k = p.k AND a.j = p.j AND a.i = p.i
  LEFT JOIN lev b ON b.t = p.t AND b.k = p.k AND b.j = p.j + (ax = 'y')::INT AND b.i = p.i + (ax = 'x')::INT
  LEFT JOIN lev c ON c.t = p.t AND c.k = p.k AND c.j = p.j + 2 * (ax = 'y')::INT AND c.i = p.i + 2 * (ax = 'x')::INT
),
fs AS (SELECT *, vel * area AS q FROM fs0 WHERE NOT absent),
fsb AS (
  SELECT *, salt * q AS qs, salt * salt * q AS qss,
         CAST(CASE WHEN salt BETWEEN 0 AND 40 THEN least(floor(salt / 0.5e0), 79) END AS INTEGER) AS salt_idx
  FROM fs
)
"""

_INCV = "i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1"

_STATS = f"""
vs AS (
  SELECT cv_id, t, sum(dv) AS v, coalesce(sum(salt * dv), 0) AS sv, coalesce(sum(salt * salt * dv), 0) AS ssv,
         coalesce(sum(salt * dv), 0) / sum(dv) AS sbar
  FROM lev, cv WHERE {_INCV} GROUP BY ALL
),
vv AS (
  SELECT cv.cv_id, l.t, sum(power(salt - sbar, 2) * dv) AS svar
  FROM lev l, cv, vs WHERE {_INCV} AND vs.cv_id = cv.cv_id AND vs.t = l.t GROUP BY ALL
),
st AS (SELECT vs.*, coalesce(svar, 0) AS svar FROM vs JOIN vv USING (cv_id, t))
"""

_TEND = """
td AS (
  SELECT cv_id, t, (v - lag(v) OVER w) / 3600 AS dvdt, (sv - lag(sv) OVER w) / 3600 AS dsvdt,
         (ssv - lag(ssv) OVER w) / 3600 AS dssvdt, (svar - lag(svar) OVER w) / 3600 AS dsvardt
  FROM st WINDOW w AS (PARTITION BY cv_id ORDER BY t)
  QUALIFY lag(t) OVER w IS NOT NULL
)
"""


def _split(prefixes: list[str], source: str, keys: str) -> str:
    """Sign split of the nets of every class in ``source``."""
    sums = ",\n         ".join(
        f'coalesce(sum({p}net) FILTER (WHERE {p}net > 0), 0) AS "{p}in", '
        f'coalesce(sum({p}net) FILTER (WHERE {p}net < 0), 0) AS "{p}out"'
        for p in prefixes
    )
    return f"bulk AS (SELECT {keys}, {sums} FROM {source} GROUP BY ALL)"


_NAMES = {"Qs": ("s", "saltadv"), "Qss": ("ss", "ssaltadv"), "Qsvar": ("svar", "svaradv")}


def _bulk_columns(prefixes: list[str]) -> dict[str, str]:
    out = {}
    for p in prefixes:
        out[f"{p}in"], out[f"{p}out"] = f"{p}in", f"{p}out"
    out["voladv"] = "Qin + Qout"
    for p in prefixes[1:]:
        v, a = _NAMES[p]
        into, outof = f"{p}in / nullif(Qin, 0)", f"{p}out / nullif(Qout, 0)"
        out[f"{v}in"], out[f"{v}out"] = into, outof
        out[a] = f"coalesce(Qin * ({into}), 0) + coalesce(Qout * ({outof}), 0)"
    return out


def _step(digits: int) -> str:
    return f"{math.pi * 10.0**-digits:.17e}"


def _stepped(expression: str, digits: int) -> str:
    """To multiples of pi / 10^digits."""
    return f"round(({expression}) / {_step(digits)}) * {_step(digits)} + 0.0e0"


def _select(columns: dict[str, str], digits: dict[str, int] | None = None, steps: dict[str, int] | None = None) -> str:
    """Columns, rounded to a number of decimal digits or to steps of pi / 10^digits."""
    digits, steps = digits or {}, steps or {}

    def one(n: str, e: str) -> str:
        if n in steps:
            return f'{_stepped(e, steps[n])} AS "{n}"'
        return f'round({e}, {digits[n]}) + 0.0e0 AS "{n}"' if n in digits else f'{e} AS "{n}"'

    return ", ".join(one(n, e) for n, e in columns.items())


def _flow(base: str, net_source: str, values: list[str], extra: str = "", digits=None, steps=None, where: str = "salt_idx IS NOT NULL", idx: str = "") -> str:
    prefix = {"q": "Q", "qs": "Qs", "qss": "Qss", "qsvar": "Qsvar"}
    ps = [prefix[v] for v in values]
    # without a second dimension a step keeps its row when no sample falls in a class
    inside = "" if idx else f" FILTER (WHERE {where})"
    nets = ", ".join(f"coalesce(sum(sgn * {v}){inside}, 0) AS {prefix[v]}net" for v in values)
    keys = "cv_id, ocean_time" + idx
    chosen = f" WHERE {where}" if idx else ""
    return f"""WITH {base},
net AS (SELECT {keys}, salt_idx, {nets} FROM {net_source}{chosen} GROUP BY ALL),
{_split(ps, "net", keys)}
SELECT {keys}{extra}, {_select(_bulk_columns(ps), digits, steps)} FROM bulk"""


_SB = "(salt_idx + 0.5e0) * 0.5e0 AS salt_bin"
_TB = "temp_idx + 0.5e0 AS temp_bin"
_DB = "-65 + (depth_idx + 0.5e0) * 1.25e0 AS depth_bin"


def _exchange_sql() -> dict[str, str]:
    out = {
        "tef_bulk": _flow(_TEF, "tefb", ["q", "qs"]),
        "tef_net": f"""WITH {_TEF}
SELECT cv_id, ocean_time, salt_idx, {_SB}, sum(sgn * q) AS "Qnet", sum(sgn * qs) AS "Qsnet", sum(sgn * qss) AS "Qssnet"
FROM tefb WHERE salt_idx IS NOT NULL GROUP BY ALL""",
        "tef_full_ss": _flow(
            _TEFVAR, "tefv", ["q", "qs", "qss", "qsvar"], steps={"Qsvarin": 4, "Qsvarout": 4, "svaradv": 4, "svarin": 7, "svarout": 7},
        ),
        "tef_normalized": _flow(
            _TEFVAR + ",\ntefn AS (SELECT * REPLACE (q / dv AS q, qsvar / dv AS qsvar) FROM tefv)", "tefn", ["q", "qsvar"],
            steps=dict.fromkeys(("Qin", "Qout", "voladv", "Qsvarin", "Qsvarout", "svaradv", "svarin", "svarout"), 8),
        ),
        "tef_steps": f"""WITH {_TEF},
net AS (
  SELECT cv_id, ocean_time, CASE WHEN salt BETWEEN 36.5 AND 37 THEN least(floor((salt - 36.5) / 0.125e0), 3) END AS at,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 THEN sgn * q ELSE 0 END) AS Qnet,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 THEN sgn * q * salt ELSE 0 END) AS Qsnet
  FROM tef GROUP BY ALL
),
{_split(["Q", "Qs"], "net", "cv_id, ocean_time")}
SELECT cv_id, ocean_time, {_select(_bulk_columns(["Q", "Qs"]))} FROM bulk""",
        "tef_ts_steps": f"""WITH {_TEF},
net AS (
  SELECT cv_id, ocean_time, CASE WHEN salt BETWEEN 36.5 AND 37 THEN least(floor((salt - 36.5) / 0.125e0), 3) END AS at,
         CAST(CASE WHEN temp BETWEEN 2 AND 10 THEN least(floor(temp - 2), 7) END AS INTEGER) AS temp_idx,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 AND temp BETWEEN 2 AND 10 THEN sgn * q ELSE 0 END) AS Qnet,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 AND temp BETWEEN 2 AND 10 THEN sgn * q * salt ELSE 0 END) AS Qsnet
  FROM tef GROUP BY ALL
),
{_split(["Q", "Qs"], "net", "cv_id, ocean_time, temp_idx")},
full_ AS (SELECT * FROM bulk WHERE temp_idx IS NOT NULL
  UNION ALL SELECT * FROM bulk b WHERE temp_idx IS NULL
    AND NOT EXISTS (SELECT 1 FROM bulk o WHERE o.cv_id = b.cv_id AND o.ocean_time = b.ocean_time AND o.temp_idx IS NOT NULL))
SELECT cv_id, ocean_time, temp_idx, 2 + (temp_idx + 0.5e0) AS temp_bin, {_select(_bulk_columns(["Q", "Qs"]))} FROM full_""",
        "tef_ts_dense": f"""WITH {_TEF},
net AS (
  SELECT cv_id, ocean_time, CASE WHEN salt BETWEEN 36.5 AND 37 THEN least(floor((salt - 36.5) / 0.125e0), 3) END AS at,
         CAST(CASE WHEN temp BETWEEN 2 AND 10 THEN least(floor(temp - 2), 7) END AS INTEGER) AS temp_idx,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 AND temp BETWEEN 2 AND 10 THEN sgn * q ELSE 0 END) AS Qnet,
         sum(CASE WHEN salt BETWEEN 36.5 AND 37 AND temp BETWEEN 2 AND 10 THEN sgn * q * salt ELSE 0 END) AS Qsnet
  FROM tef GROUP BY ALL
),
{_split(["Q", "Qs"], "net", "cv_id, ocean_time, temp_idx")},
full_ AS (
  SELECT cv_id, ocean_time, temp_idx, coalesce(Qin, 0) AS Qin, coalesce(Qout, 0) AS Qout, coalesce(Qsin, 0) AS Qsin, coalesce(Qsout, 0) AS Qsout
  FROM (SELECT DISTINCT cv_id, ocean_time FROM tef) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS temp_idx)
  LEFT JOIN bulk USING (cv_id, ocean_time, temp_idx)
)
SELECT cv_id, ocean_time, temp_idx, 2 + (temp_idx + 0.5e0) AS temp_bin, {_select(_bulk_columns(["Q", "Qs"]))} FROM full_""",
        "tef_ts_500": f"""WITH {_TEF},
c AS (SELECT 37.3e0 / 500 AS ws, (39.7e0 - 0.1e0) / 500 AS wt),
g AS (
  SELECT *, least(floor(salt / ws), 499) AS gs, least(floor((temp - 0.1e0) / wt), 499) AS gt
  FROM tef, c WHERE salt BETWEEN 0 AND 37.3e0 AND temp BETWEEN 0.1e0 AND 39.7e0
),
e AS (
  SELECT *, CASE WHEN salt < gs * ws THEN gs - 1 WHEN gs < 499 AND salt >= (gs + 1) * ws THEN gs + 1 ELSE gs END AS si,
         CASE WHEN temp < 0.1e0 + gt * wt THEN gt - 1 WHEN gt < 499 AND temp >= 0.1e0 + (gt + 1) * wt THEN gt + 1 ELSE gt END AS ti
  FROM g
)
SELECT cv_id, CAST(si AS INTEGER) AS salt_idx, CAST(ti AS INTEGER) AS temp_idx, round((si + 0.5e0) * any_value(ws), 9) + 0.0e0 AS salt_bin,
       round(0.1e0 + (ti + 0.5e0) * any_value(wt), 9) + 0.0e0 AS temp_bin, sum(sgn * q) AS "Qnet", sum(sgn * q * salt) AS "Qsnet"
FROM e GROUP BY cv_id, si, ti""",
        "tef_ts": _flow(
            _TEF, "tefb", ["q", "qs"], extra=f", {_TB}", idx=", temp_idx",
            where="salt_idx IS NOT NULL AND temp_idx IS NOT NULL",
        ),
        "tef_depth": _flow(
            _TEF, "tefb", ["q", "qs"], extra=f", {_DB}", idx=", depth_idx",
            where="salt_idx IS NOT NULL AND depth_idx IS NOT NULL",
        ),
        "tef_boxes": _flow(f"{_GRID},\n{_cv(_SPLIT)},\n{_FACES}", "fsb", ["q", "qs"]),
    }
    cols = _bulk_columns(["Q", "Qs", "Qss", "Qsvar"])
    keep = ["Qin", "Qout", "sin", "sout", "ssaltadv", "Qsvarin", "Qsvarout", "svaradv"]
    nets = ", ".join(f"coalesce(sum(sgn * {v}), 0) AS {p}net" for v, p in (("q", "Q"), ("qs", "Qs"), ("qss", "Qss"), ("qsvar", "Qsvar")))
    # the model-output query joins the mean salinity of the box, which every step has
    out["tef_model_output"] = f"""WITH {_GRID},
{_cv(_BOX + ", " + _HALF)},
{_FACES},
{_STATS},
fv AS (SELECT f.*, q * power(salt - sbar, 2) AS qsvar FROM fsb f JOIN vs ON vs.cv_id = f.cv_id AND vs.t = f.ocean_time),
net AS (SELECT cv_id, ocean_time, salt_idx, {nets} FROM fv WHERE salt_idx IS NOT NULL GROUP BY ALL),
{_split(["Q", "Qs", "Qss", "Qsvar"], "net", "cv_id, ocean_time")}
SELECT cv_id, ocean_time, {_select({n: cols[n] for n in keep}, {"Qsvarin": 3, "Qsvarout": 3, "svaradv": 3})} FROM bulk"""
    out["tef_halfopen_mean"] = f"""WITH {_GRID},
{_cv(_BOX)},
{_FACES},
cvm AS (SELECT cv_id, i0, i1 - 1 AS i1, j0, j1 - 1 AS j1 FROM cv),
{_STATS.replace("lev, cv ", "lev, cvm ").replace("lev l, cv, vs", "lev l, cvm, vs").replace("cv.cv_id", "cvm.cv_id")},
fv AS (SELECT f.*, q * power(salt - sbar, 2) AS qsvar FROM fsb f JOIN vs ON vs.cv_id = f.cv_id AND vs.t = f.ocean_time),
net AS (SELECT cv_id, ocean_time, salt_idx, {nets} FROM fv WHERE salt_idx IS NOT NULL GROUP BY ALL),
{_split(["Q", "Qs", "Qss", "Qsvar"], "net", "cv_id, ocean_time")}
SELECT cv_id, ocean_time, {_select({n: cols[n] for n in ("Qsvarin", "Qsvarout", "svaradv")}, {"Qsvarin": 3, "Qsvarout": 3, "svaradv": 3})} FROM bulk"""
    out["bin_count_compare"] = f"""WITH {_TEF},
net AS (
  SELECT cv_id, ocean_time, n_bins, floor(salt_idx / (80 / n_bins)) AS at, sum(sgn * q) AS Qnet, sum(sgn * qs) AS Qsnet
  FROM tefb, (VALUES (20), (40), (80)) c(n_bins) WHERE salt_idx IS NOT NULL GROUP BY ALL
),
{_split(["Q", "Qs"], "net", "cv_id, ocean_time, n_bins")}
SELECT cv_id, ocean_time, n_bins, {_select(_bulk_columns(["Q", "Qs"]))} FROM bulk"""
    return out


def _histogram_sql() -> dict[str, str]:
    def faces(base: str, source: str, sums: dict[str, str], two: str = "") -> str:
        idx = {"": ("", "", ""), "temp": (", temp_idx", f", {_TB}", " AND temp_idx IS NOT NULL"),
               "depth": (", depth_idx", f", {_DB}", " AND depth_idx IS NOT NULL")}[two]
        cols = ", ".join(f"{e} AS {n}" for n, e in sums.items())
        return f"""WITH {base}
SELECT cv_id, ocean_time, face, salt_idx{idx[0]}, {_SB}{idx[1]}, {cols}
FROM {source} WHERE salt_idx IS NOT NULL{idx[2]} GROUP BY ALL"""

    svar = _stepped("sum(qsvar)", 4)
    incv = f"WITH {_CHI},\n{_cv(_BOX)}"
    insplit = f"WITH {_CHI},\n{_cv(_SPLIT)}"
    return {
        "hist_vol": faces(_TEF, "tefb", {"q": "sum(q)"}),
        "hist_salt": faces(_TEF, "tefb", {"qs": "sum(qs)"}),
        "hist_ssq": faces(_TEF, "tefb", {"qss": "sum(qss)"}),
        "hist_svar": faces(_TEFVAR, "tefv", {"qsvar": svar}),
        "hist_ts": faces(_TEFVAR, "tefv", {"q": "sum(q)", "qs": "sum(qs)", "qsvar": svar}, "temp"),
        "hist_sz": faces(_TEFVAR, "tefv", {"q": "sum(q)", "qs": "sum(qs)", "qss": "sum(qss)", "qsvar": svar}, "depth"),
        "hist_dense": f"""WITH {_TEF},
ks AS (SELECT DISTINCT cv_id, ocean_time FROM tefb),
bins AS (SELECT CAST(unnest(range(80)) AS INTEGER) AS salt_idx),
s AS (SELECT cv_id, ocean_time, salt_idx, sum(q) AS q, sum(qs) AS qs FROM tefb GROUP BY ALL)
SELECT cv_id, ocean_time, salt_idx, {_SB}, coalesce(q, 0) AS q, coalesce(qs, 0) AS qs
FROM ks CROSS JOIN bins LEFT JOIN s USING (cv_id, ocean_time, salt_idx)""",
        "hist_dense_ts": f"""WITH {_TEF},
b AS (
  SELECT cv_id, CAST(date_trunc('year', ocean_time) AS TIMESTAMP) AS ocean_time, q,
         CASE WHEN salt BETWEEN 0 AND 30 THEN least(floor(salt / 2), 14) END AS salt_idx,
         CASE WHEN temp BETWEEN 5 AND 35 THEN least(floor((temp - 5) / 2), 14) END AS temp_idx
  FROM tef
),
ks AS (SELECT DISTINCT cv_id, ocean_time FROM b),
bs AS (SELECT unnest(range(15)) AS salt_idx), bt AS (SELECT unnest(range(15)) AS temp_idx),
s AS (SELECT cv_id, ocean_time, salt_idx, temp_idx, sum(q) AS q FROM b GROUP BY ALL)
SELECT cv_id, ocean_time, CAST(salt_idx AS INTEGER) AS salt_idx, CAST(temp_idx AS INTEGER) AS temp_idx,
       salt_idx * 2 + 1.0e0 AS salt_bin, 5 + temp_idx * 2 + 1.0e0 AS temp_bin, coalesce(q, 0) AS q
FROM ks CROSS JOIN bs CROSS JOIN bt LEFT JOIN s USING (cv_id, ocean_time, salt_idx, temp_idx)""",
        "hist_dropped": f"""WITH {_TEF}
SELECT cv_id, count(*) AS n_samples, count(*) FILTER (WHERE NOT (salt BETWEEN 5 AND 30)) AS n_dropped FROM tef GROUP BY cv_id""",
        "hist_density": f"""WITH {_TEF},
c AS (SELECT cv_id, salt_idx, count(*) AS n FROM tefb WHERE salt_idx IS NOT NULL GROUP BY ALL)
SELECT cv_id, salt_idx, {_SB}, n, round(n / (sum(n) OVER (PARTITION BY cv_id)) / 0.5e0, 12) + 0.0e0 AS density FROM c""",
        "hist_density_dense": f"""WITH {_TEF},
b AS (SELECT CAST(unnest(range(120)) AS INTEGER) AS salt_idx),
c AS (SELECT cv_id, CAST(floor((salt + 10) * 2) AS INTEGER) AS salt_idx, count(*) AS n FROM tef GROUP BY ALL)
SELECT k.cv_id, salt_idx, -10 + (salt_idx + 0.5e0) * 0.5e0 AS salt_bin, coalesce(n, 0) AS n,
       round(coalesce(n, 0) / (sum(n) OVER (PARTITION BY k.cv_id)) / 0.5e0, 12) + 0.0e0 AS density
FROM (SELECT DISTINCT cv_id FROM tef) k CROSS JOIN b LEFT JOIN c USING (cv_id, salt_idx)""",
        "hist_quantile_edges": f"""WITH {_TEF},
h AS (SELECT least(floor(salt * 16), 639) AS i, count(*) AS c FROM tef WHERE salt BETWEEN 0 AND 40 GROUP BY 1),
cum AS (SELECT i, sum(c) OVER (ORDER BY i) AS seen, sum(c) OVER () AS total FROM h),
e AS (
  SELECT min(i) / 16.0e0 AS edge FROM h
  UNION SELECT (min(i) + 1) / 16.0e0 FROM cum, (SELECT unnest(range(1, 13)) AS k) WHERE seen * 12 >= k * total GROUP BY k
),
b AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS salt_idx, edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, max(edge) OVER () AS top FROM e),
c AS (
  SELECT cv_id, CAST(salt_idx AS INTEGER) AS salt_idx, lo, hi, count(*) AS n
  FROM tef JOIN b ON salt >= lo AND (salt < hi OR (hi = top AND salt = hi)) GROUP BY ALL
)
SELECT cv_id, salt_idx, lo AS salt_lo, hi AS salt_hi, 0.5e0 * (lo + hi) AS salt_bin, n,
       round(n / (sum(n) OVER (PARTITION BY cv_id)) / (hi - lo), 12) + 0.0e0 AS density FROM c""",
        "hist_minmax50": f"""WITH {_TEF},
x AS (SELECT q FROM tef WHERE salt >= 36.75),
m AS (SELECT min(q) AS lo, max(q) AS hi, (max(q) - min(q)) / 50 AS w FROM x),
e AS (
  SELECT k, lo + k * w AS a, CASE WHEN k = 49 THEN hi ELSE lo + (k + 1) * w END AS b
  FROM m, (SELECT unnest(range(50)) AS k)
)
SELECT CAST(k AS INTEGER) AS vel_idx, a AS vel_lo, count(q) AS n
FROM e LEFT JOIN x ON q >= a AND (q < b OR (k = 49 AND q = b)) GROUP BY ALL""",
        "vol_by_salt": f"""{insplit}
SELECT cv_id, t AS ocean_time, salt_idx, {_SB}, sum(dv) AS "dV_saltcoord"
FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL GROUP BY ALL""",
        "saltcontent_by_salt": f"""{insplit}
SELECT cv_id, t AS ocean_time, salt_idx, {_SB}, sum(dv * salt) AS "dVs_saltcoord"
FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL GROUP BY ALL""",
        "depth_vol_ts": f"""{incv},
s AS (
  SELECT salt_idx, temp_idx, -sum(z_rho) AS zrh, sum(dv) AS vint FROM levc, cv
  WHERE {_INCV} AND salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL
)
SELECT salt_idx, temp_idx, zrh, vint, CASE WHEN zrh > 0 THEN round(log10(zrh), 10) + 0.0e0 END AS log_zrh,
       CASE WHEN vint > 0 THEN round(log10(vint), 10) + 0.0e0 END AS log_vint FROM s""",
        "entrainment": f"""{incv},
s AS (
  SELECT cv_id, t, CAST(least(floor(salt / 2), 19) AS INTEGER) AS salt_idx, sum(dv) AS v
  FROM levc, cv WHERE {_INCV} AND salt BETWEEN 0 AND 40 GROUP BY ALL
),
dense AS (
  SELECT cv_id, t, salt_idx, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT cv_id, t FROM levc, cv WHERE {_INCV}) CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS salt_idx)
  LEFT JOIN s USING (cv_id, t, salt_idx)
)
SELECT cv_id, t AS ocean_time, salt_idx, salt_idx * 2 + 1.0e0 AS salt_bin, (v - lag(v) OVER w) / 3600 AS "ddV_saltcoorddt"
FROM dense WINDOW w AS (PARTITION BY cv_id, salt_idx ORDER BY t) QUALIFY lag(t) OVER w IS NOT NULL""",
        "entrainment_ts": f"""{incv},
c AS (SELECT 37.3e0 / 500 AS ws, (39.7e0 - 0.1e0) / 500 AS wt),
g AS (
  SELECT *, least(floor(salt / ws), 499) AS gs, least(floor((temp - 0.1e0) / wt), 499) AS gt
  FROM levc, cv, c WHERE {_INCV} AND salt BETWEEN 0 AND 37.3e0 AND temp BETWEEN 0.1e0 AND 39.7e0
),
s AS (
  SELECT cv_id, t, CASE WHEN salt < gs * ws THEN gs - 1 WHEN gs < 499 AND salt >= (gs + 1) * ws THEN gs + 1 ELSE gs END AS si,
         CASE WHEN temp < 0.1e0 + gt * wt THEN gt - 1 WHEN gt < 499 AND temp >= 0.1e0 + (gt + 1) * wt THEN gt + 1 ELSE gt END AS ti, sum(dv) AS v
  FROM g GROUP BY ALL
),
st AS (SELECT cv_id, t, lag(t) OVER (PARTITION BY cv_id ORDER BY t) AS before FROM (SELECT DISTINCT cv_id, t FROM levc, cv WHERE {_INCV})),
own AS (SELECT s.*, st.before FROM s JOIN st USING (cv_id, t)),
late AS (SELECT s.cv_id, st.t, si, ti, v FROM s JOIN st ON st.cv_id = s.cv_id AND st.before = s.t)
SELECT cv_id, t AS ocean_time, CAST(si AS INTEGER) AS salt_idx, CAST(ti AS INTEGER) AS temp_idx,
       (coalesce(own.v, 0) - coalesce(late.v, 0)) / 3600 AS "ddVdt"
FROM (SELECT * FROM own WHERE before IS NOT NULL) own FULL JOIN late USING (cv_id, t, si, ti)""",
        "chi_series": f"""{insplit}
SELECT cv_id, t AS ocean_time, round(coalesce(sum(chi * dv), 0), 6) + 0.0e0 AS chi FROM levc, cv WHERE {_INCV} GROUP BY ALL""",
        "chi_by_salt": f"""{incv}
SELECT cv_id, t AS ocean_time, salt_idx, {_SB}, round(coalesce(sum(chi * dv), 0), 6) + 0.0e0 AS chi
FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL GROUP BY ALL""",
        "chi_ts": f"""{incv}
SELECT cv_id, t AS ocean_time, salt_idx, temp_idx, {_SB}, {_TB}, round(coalesce(sum(chi * dv), 0), 6) + 0.0e0 AS chi
FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL""",
        "chi_sz": f"""{incv}
SELECT cv_id, t AS ocean_time, salt_idx, depth_idx, {_SB}, {_DB}, round(coalesce(sum(chi), 0), 12) + 0.0e0 AS chi
FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL AND depth_idx IS NOT NULL GROUP BY ALL""",
        "chi_per_volume": f"""{insplit},
s AS (
  SELECT cv_id, t AS ocean_time, salt_idx, temp_idx, coalesce(sum(chi), 0) AS cu, sum(dv) AS v
  FROM levc, cv WHERE {_INCV} AND salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL
)
SELECT cv_id, ocean_time, salt_idx, temp_idx, {_SB}, {_TB}, round(cu, 12) + 0.0e0 AS chi_unit, v AS "dV_saltcoord",
       round(cu / v, 16) + 0.0e0 AS chi_per_v FROM s""",
    }


def _budget_sql() -> dict[str, str]:
    base = lambda rows: f"WITH {_CHI},\n{_cv(rows)}"
    bulk = _bulk_columns(["Q", "Qs", "Qss", "Qsvar"])
    nets = ", ".join(f"coalesce(sum(sgn * {v}), 0) AS {p}net" for v, p in (("q", "Q"), ("qs", "Qs"), ("qss", "Qss"), ("qsvar", "Qsvar")))

    def terms(rows: str) -> str:
        return f"""{base(rows)},
{_FACES},
{_STATS},
{_TEND},
fv AS (SELECT f.*, q * power(salt - sbar, 2) AS qsvar FROM fsb f JOIN vs ON vs.cv_id = f.cv_id AND vs.t = f.ocean_time),
net AS (SELECT cv_id, ocean_time AS t, salt_idx, {nets} FROM fv WHERE salt_idx IS NOT NULL GROUP BY ALL),
{_split(["Q", "Qs", "Qss", "Qsvar"], "net", "cv_id, t")},
adv AS (SELECT cv_id, t, {_select({n: bulk[n] for n in ("voladv", "saltadv", "ssaltadv", "svaradv")})} FROM bulk),
mix AS (SELECT cv_id, t, coalesce(sum(chi * dv), 0) AS chi FROM levc, cv WHERE {_INCV} GROUP BY ALL),
term AS (
  SELECT td.*, coalesce(voladv, 0) AS voladv, coalesce(saltadv, 0) AS saltadv, coalesce(ssaltadv, 0) AS ssaltadv,
         coalesce(svaradv, 0) AS svaradv, chi
  FROM td LEFT JOIN adv USING (cv_id, t) JOIN mix USING (cv_id, t)
)"""

    def pct(n, supply, storage, digits, scale="", pct_digits=None):
        a, b = (f"(round(sum({x}){scale}, {digits}) + 0.0e0)" for x in (supply, storage))
        return (
            f"{a} AS {n}_supply, {b} AS {n}_storage, "
            f"round(({a} - {b}) / nullif({b}, 0) * 100, {digits if pct_digits is None else pct_digits}) + 0.0e0 AS {n}_pct"
        )

    surface = f"""{terms(_BOX)},
flux AS (
  SELECT cv_id, t, sum(swflux / pm / pn) / 100 / 86400 AS sw, sum(ssflux / pm / pn) AS ss
  FROM col, cv WHERE {_INCV} GROUP BY ALL
),
sf AS (
  SELECT cv_id, t AS ocean_time, voladv + sw AS volume_supply, dvdt - (voladv + sw) AS volume_residual,
         saltadv + ss AS salt_supply, ss * ss / nullif(sw, 0) AS s2flux, ssaltadv + ss * ss / nullif(sw, 0) - chi AS ssalt_supply,
         dsvdt, dvdt
  FROM term JOIN flux USING (cv_id, t)
)"""
    return {
        "cv_volume_stats": f"""WITH {_GRID},
{_cv(_BOX + ", " + _SPLIT.split("), ", 1)[1])},
{_STATS}
SELECT cv_id, t AS ocean_time, v AS "V", sv AS "sV", ssv AS "ssV", sbar, round(svar, 0) + 0.0e0 AS "svarV" FROM st""",
        "tendencies": f"""WITH {_GRID},
{_cv(_SPLIT)},
{_STATS},
{_TEND}
SELECT cv_id, t AS ocean_time, dvdt AS "dVdt", dsvdt AS "dsVdt", dssvdt AS "dssVdt", round(dsvardt, 4) + 0.0e0 AS dsvardt FROM td""",
        "closure": f"""{terms(_SPLIT)}
SELECT cv_id, {pct("volume", "voladv", "dvdt", 0, " * 3600", 4)}, {pct("salt", "saltadv", "dsvdt", 0, " * 3600", 4)},
  {pct("ssalt", "(ssaltadv - chi)", "dssvdt", 0, " * 3600", 4)}, {pct("svar", "(svaradv - chi)", "dsvardt", 0, " * 3600", 4)}
FROM term GROUP BY cv_id""",
        "surface_flux": f"""{base(_BOX)},
fw AS (SELECT cv_id, t, sum(swflux / pm / pn) / 100 / 86400 AS sw FROM col, cv WHERE {_INCV} GROUP BY ALL),
sl AS (
  SELECT cv_id, t, sum(ssflux / pm / pn) AS ss, coalesce(sum(ssflux / nullif(salt, 0) / pm / pn), 0) AS sv
  FROM lev, cv WHERE k = 6 AND {_INCV} GROUP BY ALL
)
SELECT cv_id, t AS ocean_time, round(sw, 9) + 0.0e0 AS swflux, ss AS ssflux, round(sv, 6) + 0.0e0 AS svolflux
FROM fw JOIN sl USING (cv_id, t)""",
        "surface_forcing": f"""{base(_SPLIT)},
fw AS (SELECT cv_id, t, sum(swflux / pm / pn) / 100 / 86400 AS sw FROM col, cv WHERE {_INCV} GROUP BY ALL),
pr AS (SELECT *, lead(t) OVER w AS tb, lead(sw) OVER w AS sb, first_value(t) OVER w AS t0 FROM fw WINDOW w AS (PARTITION BY cv_id ORDER BY t)),
ex AS (
  SELECT *, unnest(CASE WHEN tb IS NULL THEN [t] ELSE generate_series(t, tb - INTERVAL 1 DAY, INTERVAL 1 DAY) END) AS x FROM pr
)
SELECT cv_id, x AS ocean_time,
  round(CASE WHEN x = t THEN sw ELSE sw + (sb - sw) * (epoch(x) - epoch(t)) / (epoch(tb) - epoch(t)) END, 8) + 0.0e0 AS swflux
FROM ex WHERE x > t0""",
        "surface_budget": f"""{surface}
SELECT cv_id, ocean_time, round(volume_supply, 4) + 0.0e0 AS volume_supply, round(volume_residual, 4) + 0.0e0 AS volume_residual,
       round(salt_supply, 4) + 0.0e0 AS salt_supply, round(s2flux, 4) + 0.0e0 AS s2flux, round(ssalt_supply, 2) + 0.0e0 AS ssalt_supply
FROM sf""",
        "surface_closure": f"""{surface}
SELECT cv_id, {pct("salt", "salt_supply", "dsvdt", 3)}, {pct("volume", "volume_supply", "dvdt", 3)} FROM sf GROUP BY cv_id""",
    }


def _grid_sql() -> dict[str, str]:
    key = "CAST({0}k AS INTEGER) AS k, CAST({0}j AS INTEGER) AS j, CAST({0}i AS INTEGER) AS i"
    ji = "CAST({0}j AS INTEGER) AS j, CAST({0}i AS INTEGER) AS i"
    near = lambda x, dj, di, on="": f"LEFT JOIN {x} ON {x}.j = a.j + {dj} AND {x}.i = a.i + {di}{on}"

    def stag(point: str, w: bool) -> str:
        shifts = {"u": [(0, 0), (0, 1)], "v": [(0, 0), (1, 0)], "psi": [(0, 0), (0, 1), (1, 0), (1, 1)]}[point]
        n = len(shifts)
        names = [f"n{m}" for m in range(n)]
        src = "wl" if w else "rl"
        joins = " ".join(
            f"JOIN {src} n{m} ON n{m}.t = n0.t AND n{m}.k = n0.k AND n{m}.j = n0.j + {dj} AND n{m}.i = n0.i + {di}"
            for m, (dj, di) in enumerate(shifts) if m
        )
        mean = lambda c: "(" + " + ".join(f"{x}.{c}" for x in names) + f") / {n}"
        return f"""SELECT n0.t AS ocean_time, {key.format('n0.')}, '{point}{"_w" if w else ""}' AS place,
  {mean("z")} AS z, {mean("z0")} AS z0, {mean("dz")} AS dz, {mean("dz0")} AS dz0,
  round({mean("dz")} / ({mean("pm")}) / ({mean("pn")}), 2) + 0.0e0 AS "dV"
FROM {src} n0 {joins}"""

    wl = """
wl0 AS (SELECT c.*, r.k, zeta + (zeta + h) * (r.k / 8.0e0 - 0.875e0) AS z, h * (r.k / 8.0e0 - 0.875e0) AS z0
        FROM col c CROSS JOIN (SELECT unnest(range(8)) AS k) r),
cz AS (SELECT t, j, i, k, z_rho, h * (k / 8.0e0 - 0.8125e0) AS z_rho0 FROM lev),
wl AS (
  SELECT w.*, coalesce(up.z_rho, 0) - coalesce(dn.z_rho, 0) AS dz, coalesce(up.z_rho0, 0) - coalesce(dn.z_rho0, 0) AS dz0
  FROM wl0 w LEFT JOIN cz up USING (t, j, i, k)
  LEFT JOIN cz dn ON dn.t = w.t AND dn.j = w.j AND dn.i = w.i AND dn.k = w.k - 1
),
rl AS (SELECT t, j, i, k, pm, pn, z_rho AS z, h * (k / 8.0e0 - 0.8125e0) AS z0, dz, h / 8 AS dz0 FROM lev)
"""
    gap = " AND {x}.t = a.t AND {x}.k = a.k"
    surf = f"""{_GRID},
s AS (SELECT t, j, i, pm, pn, salt FROM lev WHERE k = 6),
gr AS (
  SELECT a.t, a.j, a.i,
    (CASE WHEN a.i = 0 THEN e.salt - a.salt WHEN a.i = (SELECT 8 * m - 1 FROM refined) THEN a.salt - w.salt ELSE (a.salt - w.salt + (e.salt - a.salt)) / 2 END) * a.pm AS dsdx,
    (CASE WHEN a.j = 0 THEN n.salt - a.salt WHEN a.j = (SELECT 6 * m - 1 FROM refined) THEN a.salt - z.salt ELSE (a.salt - z.salt + (n.salt - a.salt)) / 2 END) * a.pn AS dsdy
  FROM s a LEFT JOIN s e ON e.t = a.t AND e.j = a.j AND e.i = a.i + 1 LEFT JOIN s w ON w.t = a.t AND w.j = a.j AND w.i = a.i - 1
  LEFT JOIN s n ON n.t = a.t AND n.i = a.i AND n.j = a.j + 1 LEFT JOIN s z ON z.t = a.t AND z.i = a.i AND z.j = a.j - 1
),
gm AS (SELECT *, sqrt(dsdx * dsdx + dsdy * dsdy) AS gradmag FROM gr)"""
    kin = f"""{_GRID},
s AS (
  SELECT a.t, a.j, a.i, a.pm, a.pn, (1 + a.j) / 16384.0e0 AS f, a.z_rho AS z1, b.z_rho AS z2, a.u AS u1, b.u AS u2, a.v AS v1, b.v AS v2
  FROM lev a JOIN lev b ON a.k = 6 AND b.k = 5 AND a.t = b.t AND a.j = b.j AND a.i = b.i
),
uv AS (
  SELECT a.*, (a.z1 + e.z1) / 2 AS zu, (a.u1 - a.u2) / nullif((a.z1 + e.z1) / 2 - (a.z2 + e.z2) / 2, 0) AS su,
    (a.z1 + n.z1) / 2 AS zv, (a.v1 - a.v2) / nullif((a.z1 + n.z1) / 2 - (a.z2 + n.z2) / 2, 0) AS sv
  FROM s a LEFT JOIN s e ON e.t = a.t AND e.j = a.j AND e.i = a.i + 1 LEFT JOIN s n ON n.t = a.t AND n.i = a.i AND n.j = a.j + 1
),
rho AS (
  SELECT a.*, ((a.u1 - w.u1) - (a.su + w.su) / 2 * (a.zu - w.zu)) * a.pm AS dudx, ((a.v1 - z.v1) - (a.sv + z.sv) / 2 * (a.zv - z.zv)) * a.pn AS dvdy
  FROM uv a LEFT JOIN uv w ON w.t = a.t AND w.j = a.j AND w.i = a.i - 1 LEFT JOIN uv z ON z.t = a.t AND z.i = a.i AND z.j = a.j - 1
),
psi AS (
  SELECT a.t, a.j, a.i, (a.f + e.f + n.f + d.f) / 4 AS f, (a.dudx + e.dudx + n.dudx + d.dudx) / 4 AS ux, (a.dvdy + e.dvdy + n.dvdy + d.dvdy) / 4 AS vy,
    ((n.u1 - a.u1) - (n.su + a.su) / 2 * (n.zu - a.zu)) * ((a.pn + e.pn + n.pn + d.pn) / 4) AS uy,
    ((e.v1 - a.v1) - (e.sv + a.sv) / 2 * (e.zv - a.zv)) * ((a.pm + e.pm + n.pm + d.pm) / 4) AS vx
  FROM rho a LEFT JOIN rho e ON e.t = a.t AND e.j = a.j AND e.i = a.i + 1 LEFT JOIN rho n ON n.t = a.t AND n.i = a.i AND n.j = a.j + 1
  LEFT JOIN rho d ON d.t = a.t AND d.i = a.i + 1 AND d.j = a.j + 1
)"""
    iso = f"""{_GRID},
p AS (
  SELECT t, j, i, k, h, zeta, salt - {{v}} AS a, lead(salt) OVER w - {{v}} AS b, z_rho AS za, lead(z_rho) OVER w AS zb
  FROM lev WINDOW w AS (PARTITION BY t, j, i ORDER BY k)
),
c AS (SELECT t, j, i, CASE WHEN a = 0 THEN za WHEN a * b < 0 THEN za - a * (zb - za) / (b - a) END AS z FROM p)"""
    return {
        "vertical_coords": f"""WITH {_GRID},
r AS (SELECT unnest(range(8)) AS k),
x AS (SELECT c.*, r.k, r.k / 8.0e0 - 0.875e0 AS sw, CASE WHEN r.k < 7 THEN r.k / 8.0e0 - 0.8125e0 END AS sr FROM col c CROSS JOIN r)
SELECT t AS ocean_time, {key.format('')},
  sw * h + zeta * (1 + sw * h / h) AS z_w_v1, sr * h + zeta * (1 + sr * h / h) AS z_rho_v1, sw * h AS z_w0_v1,
  zeta + (zeta + h) * ((16 * sw + sw * h) / (16 + h)) AS z_w_v2, zeta + (zeta + h) * ((16 * sr + sr * h) / (16 + h)) AS z_rho_v2,
  h * ((16 * sw + sw * h) / (16 + h)) AS z_w0_v2
FROM x""",
        "metrics_uv": f"""WITH {_GRID},
m AS (
  SELECT a.j, a.i, 1 / a.pm AS dx, 1 / a.pn AS dy, 2 / (a.pm + e.pm) AS dx_u, 2 / (a.pn + e.pn) AS dy_u,
    2 / (a.pm + n.pm) AS dx_v, 2 / (a.pn + n.pn) AS dy_v,
    4 / (a.pm + e.pm + n.pm + d.pm) AS dx_psi, 4 / (a.pn + e.pn + n.pn + d.pn) AS dy_psi
  FROM stat a LEFT JOIN stat e ON e.j = a.j AND e.i = a.i + 1 LEFT JOIN stat n ON n.j = a.j + 1 AND n.i = a.i
  LEFT JOIN stat d ON d.j = a.j + 1 AND d.i = a.i + 1
)
SELECT {ji.format('')}, {", ".join(f'round({x}{p}, 6) + 0.0e0 AS {x}{p}' for p in ("", "_u", "_v", "_psi") for x in ("dx", "dy"))},
  {", ".join(f'round(dx{p} * dy{p}, 6) + 0.0e0 AS "dA{p}"' for p in ("", "_u", "_v", "_psi"))} FROM m""",
        "interp_uv": f"""WITH {_GRID}
SELECT a.t AS ocean_time, {key.format('a.')}, (a.salt + e.salt) / 2 AS salt_u, (a.salt + n.salt) / 2 AS salt_v,
  (a.salt + e.salt + n.salt + d.salt) / 4 AS salt_psi
FROM lev a {near("lev e", 0, 1).replace("lev e.", "e.")} AND e.t = a.t AND e.k = a.k
{near("lev n", 1, 0).replace("lev n.", "n.")} AND n.t = a.t AND n.k = a.k
{near("lev d", 1, 1).replace("lev d.", "d.")} AND d.t = a.t AND d.k = a.k""",
        "interp_left_extrap": f"""WITH {_GRID},
s AS (SELECT t, j, i, salt FROM lev WHERE k = 6)
SELECT a.t AS ocean_time, {ji.format('a.')},
  CASE WHEN a.i = 0 THEN 1.5e0 * a.salt - 0.5e0 * e.salt ELSE (w.salt + a.salt) / 2 END AS salt_x,
  CASE WHEN a.j = 0 THEN 1.5e0 * a.salt - 0.5e0 * n.salt ELSE (z.salt + a.salt) / 2 END AS salt_y
FROM s a LEFT JOIN s e ON e.t = a.t AND e.j = a.j AND e.i = a.i + 1 LEFT JOIN s w ON w.t = a.t AND w.j = a.j AND w.i = a.i - 1
LEFT JOIN s n ON n.t = a.t AND n.i = a.i AND n.j = a.j + 1 LEFT JOIN s z ON z.t = a.t AND z.i = a.i AND z.j = a.j - 1""",
        "dz_family": f"""WITH {_GRID},{wl}
SELECT w.t AS ocean_time, {key.format('w.')}, dz AS dz_w, dz0 AS dz_w0, dz / pm / pn AS "dV_w",
  CASE WHEN w.k < 7 THEN (zeta + h) / 8 END AS dz, CASE WHEN w.k < 7 THEN h / 8 END AS dz0
FROM wl w""",
        "staggered_volumes": f"WITH {_GRID},{wl}\n" + "\nUNION ALL\n".join(stag(p, w) for p in ("u", "v", "psi") for w in (False, True)),
        "rest_volume": f"""WITH {_GRID} SELECT {ji.format('')}, h * 6 / 8.0e0 / pm / pn AS "dV0" FROM stat""",
        "salt_gradient": f"WITH {surf} SELECT t AS ocean_time, {ji.format('')}, dsdx, dsdy, gradmag FROM gm",
        "gradient_boxes": f"""WITH {surf},
{_cv(_SPLIT)}
SELECT cv_id, t AS ocean_time, {ji.format('')}, gradmag FROM gm, cv WHERE {_INCV}""",
        "vorticity_boxes": f"""WITH {kin},
{_cv(_SPLIT)},
b AS (
  SELECT cv_id, CAST(least(floor(((vx - uy) / f + 60) / 2), 59) AS INTEGER) AS vorticity_idx, count(*) AS n
  FROM psi, cv WHERE {_INCV} AND (vx - uy) / f BETWEEN -60 AND 60 GROUP BY ALL
)
SELECT cv_id, vorticity_idx, -60 + (vorticity_idx + 0.5e0) * 2 AS vorticity_bin, n,
  round(n / (sum(n) OVER (PARTITION BY cv_id)) / 2, 9) + 0.0e0 AS density FROM b""",
        "boxes_many": f"""WITH {_GRID},
cv AS (
  SELECT row_number() OVER (ORDER BY b, a, j, i) - 1 AS cv_id, i * m AS i0, (i + a + 1) * m - 1 AS i1, j * m AS j0, (j + b + 1) * m - 1 AS j1
  FROM (SELECT unnest(range(2)) AS b) bs, (SELECT unnest(range(2)) AS a) az, (SELECT unnest(range(6)) AS j) js, (SELECT unnest(range(8)) AS i) iz, refined
  WHERE j + b < 6 AND i + a < 8
)
SELECT CAST(cv_id AS INTEGER) AS cv_id, sum(dv) AS "V", sum(salt * dv) AS "sV", sum(salt * salt * dv) AS "ssV" FROM lev, cv WHERE {_INCV} GROUP BY cv_id""",
        "gradient_stats": f"""WITH {surf},
b AS (
  SELECT CAST(date_trunc('year', t) AS TIMESTAMP) AS period, CAST(least(floor(gradmag * 1024), 63) AS INTEGER) AS grad_idx, count(*) AS n
  FROM gm WHERE gradmag BETWEEN 0 AND 0.0625e0 GROUP BY ALL
)
SELECT period, grad_idx, (grad_idx + 0.5e0) / 1024 AS grad_bin, n,
  round(n / (sum(n) OVER (PARTITION BY period)) * 1024, 9) + 0.0e0 AS density FROM b""",
        "surface_kinematics": f"""WITH {kin}
SELECT t AS ocean_time, {ji.format('')}, round((vx - uy) / f, 8) + 0.0e0 AS vorticity, round((ux + vy) / f, 8) + 0.0e0 AS divergence,
  round(sqrt(power(ux - vy, 2) + power(vx + uy, 2)) / f, 8) + 0.0e0 AS strain FROM psi""",
        "vorticity_stats": f"""WITH {kin},
b AS (
  SELECT CAST(date_trunc('year', t) AS TIMESTAMP) AS period, CAST(least(floor(((vx - uy) / f + 60) / 2), 59) AS INTEGER) AS vorticity_idx, count(*) AS n
  FROM psi WHERE (vx - uy) / f BETWEEN -60 AND 60 GROUP BY ALL
)
SELECT period, vorticity_idx, -60 + (vorticity_idx + 0.5e0) * 2 AS vorticity_bin, n,
  round(n / (sum(n) OVER (PARTITION BY period)) / 2, 9) + 0.0e0 AS density FROM b""",
        "isohaline_depth": f"""WITH {iso.format(v="20")}
SELECT t AS ocean_time, {ji.format('')}, max(z) AS z_shallow, min(z) AS z_deep FROM c GROUP BY t, j, i""",
        "isohaline_mean": f"""WITH {iso.format(v="28.4e0")},
m AS (SELECT t, j, i, max(z) AS z FROM c GROUP BY t, j, i)
SELECT {ji.format('')}, round(avg(z), 8) + 0.0e0 AS z_iso FROM m GROUP BY ALL""",
        "time_mean_bottom": f"""WITH {_GRID}
SELECT {ji.format('')}, avg(salt) AS salt, avg(temp) AS temp FROM lev WHERE k = 0 GROUP BY ALL""",
        "box_area": f"""WITH {_GRID},
{_cv(_BOX)}
SELECT round(sum(1 / pm / pn) / 1e6, 9) + 0.0e0 AS area_km2, min(h) AS h_min, max(h) AS h_max, avg(h) AS h_mean,
  28 + min(j) / 64.0e0 AS lat_min, 28 + max(j) / 64.0e0 AS lat_max, avg(28 + j / 64.0e0) AS lat_mean,
  -95 + min(i) / 64.0e0 AS lon_min, -95 + max(i) / 64.0e0 AS lon_max, avg(-95 + i / 64.0e0) AS lon_mean,
  round(sqrt(sum(1 / pm / pn) / 1e6), 9) + 0.0e0 AS side_km FROM stat, cv WHERE {_INCV}""",
        "packed_levels": f"""WITH {_GRID}
SELECT t AS ocean_time, {key.format('')}, salt, temp, u, v FROM lev""",
        "shared_dimensions": f"""WITH {_GRID}
SELECT CAST(j AS INTEGER) AS eta_rho, CAST(i AS INTEGER) AS xi_rho, max(h) AS h, count(*) AS n, 1025.0e0 AS rho0, 1025 * max(h) AS load
FROM col GROUP BY j, i""",
        "strided_section": f"""WITH {_GRID}
SELECT t AS ocean_time, {key.format('')}, salt FROM cell WHERE i = 3 AND j % 2 = 1""",
    }


def _face_sql() -> dict[str, str]:
    beyond = "(2, 2, 4, 2, 3, 5, 4)"
    two = f"WITH {_GRID},\n{_cv(', '.join((_BOX, _HALF, beyond)))},\n{_FACES}"
    one = f"WITH {_GRID},\n{_cv(_BOX)},\n{_FACES}"
    flow = _flow(f"{_CHI},\n{_cv(_BOX)},\n{_FACES}", "fsb", ["q", "qs"])
    return {
        "face_transport": f"{two} SELECT cv_id, ocean_time, face, k, pos, vel, q FROM fs",
        "face_tracers": f"{two} SELECT cv_id, ocean_time, face, k, pos, salt, temp, z FROM fs",
        "face_area_volume": f"""{one}
SELECT cv_id, ocean_time, face, k, pos, area, round(dv, 3) + 0.0e0 AS dv, round(q / dv, 9) + 0.0e0 AS q_norm FROM fs""",
        "boxes_2x2": f"""WITH {_GRID},
{_cv(_SPLIT)},
{_FACES},
{_STATS},
x AS (
  SELECT f.cv_id, f.ocean_time, face, q, CASE WHEN face IN ('W', 'S') THEN salt_out ELSE salt END AS s,
         CASE WHEN face IN ('W', 'S') THEN temp_out ELSE temp END AS temp, sbar
  FROM (SELECT *, vel * area AS q FROM fs0 WHERE NOT (absent AND (absent2 OR face IN ('E', 'N')))) f
  JOIN vs ON vs.cv_id = f.cv_id AND vs.t = f.ocean_time
)
SELECT cv_id, ocean_time, face, count(q) AS n, sum(q) AS q, sum(s * q) AS qs, sum(s * s * q) AS qss, sum(temp) AS temp,
  round(sum(power(s - sbar, 2)), 6) + 0.0e0 AS svar, round(sum(q * power(s - sbar, 2)), 3) + 0.0e0 AS qsvar
FROM x GROUP BY ALL""",
        "sin_sout_chi": f"""WITH flow AS ({flow}),
mix AS (
  WITH {_CHI},
  {_cv(_BOX)}
  SELECT cv_id, t, coalesce(sum(chi * dv), 0) AS chi FROM levc, cv WHERE {_INCV} GROUP BY ALL
)
SELECT flow.cv_id, ocean_time, "sin", "sout", round(chi, 6) + 0.0e0 AS chi FROM flow JOIN mix ON mix.cv_id = flow.cv_id AND mix.t = flow.ocean_time""",
    }


def _series_sql() -> dict[str, str]:
    net = f"""WITH {_TEF},
net AS (
  SELECT cv_id, ocean_time, salt_idx, temp_idx, sum(sgn * q) AS qn, sum(sgn * qs) AS qsn FROM tefb
  WHERE salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL
)"""
    top = "CASE WHEN count(*) OVER w < 3200 THEN greatest(max({0}) OVER w, 0) ELSE max({0}) OVER w END"
    norm = f"""{net},
tot AS (SELECT cv_id, salt_idx, temp_idx, sum(qn) AS qn, sum(qsn) AS qsn FROM net GROUP BY ALL),
nrm AS (
  SELECT *, qn / nullif({top.format("qn")}, 0) AS a, qsn / nullif({top.format("qsn")}, 0) AS b
  FROM tot WINDOW w AS (PARTITION BY cv_id)
)"""
    hours = """
h0 AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ocean_time, sum(CAST(round(value * 100) AS BIGINT)) AS xc, count(*) AS n
  FROM events GROUP BY ALL
),
hs AS (
  SELECT x.t AS ocean_time, CAST(coalesce(xc, 0) AS BIGINT) AS xc, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM (SELECT unnest(generate_series(min(ocean_time), max(ocean_time), INTERVAL 1 HOUR)) AS t FROM h0) x
  LEFT JOIN h0 ON h0.ocean_time = x.t
)"""
    rho = "1027 * ((1 + 7.6e-4 * (salt - 35)) - 1.7e-4 * (temp - 25)) - 1000"

    def picked(label: str, where: str, source: str = "hs") -> str:
        return f"SELECT '{label}' AS selection, count(*) AS n, CAST(coalesce(sum(xc), 0) AS BIGINT) AS xc FROM {source} WHERE {where}"

    def smooth(n: int) -> str:
        lead = (n - 1) // 2
        return f"""f{n} AS (
  SELECT o.pos, sum(s.n * w.w) / (SELECT sum(w) FROM k{n}) AS n
  FROM pos o, k{n} w, pos s WHERE s.pos = o.pos + {lead} - w.b GROUP BY o.pos
),""", f"k{n} AS (SELECT b, 0.5e0 - 0.5e0 * cos(2 * pi() * b / {n - 1}) AS w FROM (SELECT unnest(range({n})) AS b)),"

    f72, k72 = smooth(72)
    f75, k75 = smooth(75)
    slices = [
        picked("day", "CAST(ocean_time AS DATE) = DATE '2024-01-03'"),
        picked("hour", "ocean_time = TIMESTAMP '2024-01-03 07:00:00'"),
        picked("instant", "ocean_time = TIMESTAMP '2024-01-20 12:00:00'"),
        picked("month", "year(ocean_time) = 2024 AND month(ocean_time) = 1"),
        picked("days_inclusive", "CAST(ocean_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'"),
        picked("stamps_inclusive", "ocean_time BETWEEN TIMESTAMP '2024-01-02 23:00:00' AND TIMESTAMP '2024-01-18 00:00:00'"),
        picked("positions", "pos BETWEEN 200 AND 719", "(SELECT *, row_number() OVER (ORDER BY ocean_time) - 1 AS pos FROM hs)"),
        picked("dates_exclusive", "ocean_time >= TIMESTAMP '2024-01-03' AND ocean_time < TIMESTAMP '2024-01-10'"),
    ]
    return {
        "marginals": f"""{net}
SELECT cv_id, salt_idx, temp_idx, sum(qn) AS "Qnet", sum(qsn) AS "Qsnet" FROM net
GROUP BY GROUPING SETS ((cv_id, salt_idx), (cv_id, temp_idx), (cv_id))""",
        "max_norm": f"""{norm}
SELECT cv_id, salt_idx, temp_idx, qn AS "Qnet", qsn AS "Qsnet", a AS "Qnet_norm", b AS "Qsnet_norm" FROM nrm""",
        "monthly_norm": f"""{net},
per AS (SELECT cv_id, ocean_time AS period, salt_idx, sum(qn) AS qn, sum(qsn) AS qsn FROM net GROUP BY ALL),
tot AS (SELECT cv_id, salt_idx, sum(qn) AS qn, sum(qsn) AS qsn FROM per GROUP BY ALL),
tops AS (
  SELECT cv_id, CASE WHEN count(*) < 80 THEN greatest(max(qn), 0) ELSE max(qn) END AS a,
         CASE WHEN count(*) < 80 THEN greatest(max(qsn), 0) ELSE max(qsn) END AS b FROM tot GROUP BY cv_id
)
SELECT cv_id, period, salt_idx, qn AS "Qnet", qsn AS "Qsnet", qn / nullif(a, 0) AS "Qnet_norm", qsn / nullif(b, 0) AS "Qsnet_norm"
FROM per JOIN tops USING (cv_id)""",
        "std_norm": f"""{norm},
full_grid AS (
  SELECT c.cv_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b
  FROM (SELECT DISTINCT cv_id FROM nrm) c CROSS JOIN (SELECT unnest(range(80)) AS salt_idx) CROSS JOIN (SELECT unnest(range(40)) AS temp_idx)
  LEFT JOIN nrm USING (cv_id, salt_idx, temp_idx)
)
SELECT cv_id, round(stddev_pop(a), 9) + 0.0e0 AS "Qnet_norm_std", round(stddev_pop(b), 9) + 0.0e0 AS "Qsnet_norm_std" FROM full_grid GROUP BY cv_id""",
        "log_hist": f"""{net},
tot AS (SELECT cv_id, salt_idx, sum(qn) AS qn FROM net GROUP BY ALL)
SELECT cv_id, salt_idx, qn AS "Qnet", CASE WHEN qn > 0 THEN round(log10(qn), 10) + 0.0e0 END AS "log_Qnet" FROM tot""",
        "peak_class": f"""{net},
tot AS (SELECT cv_id, {_SB}, sum(qn) AS qn FROM net GROUP BY ALL)
SELECT cv_id, min(salt_bin) AS salt_bin, any_value(qn) AS "Qnet"
FROM (SELECT *, max(qn) OVER (PARTITION BY cv_id) AS top FROM tot) WHERE qn = top GROUP BY cv_id""",
        "merged_results": f"""WITH {_TEF},
a AS (SELECT cv_id, ocean_time, count(*) AS n_fresh FROM tef WHERE salt < 1 GROUP BY ALL),
b AS (SELECT cv_id, ocean_time, sum(q) AS q_deep FROM tef WHERE z < -64 GROUP BY ALL)
SELECT cv_id, ocean_time, n_fresh, q_deep FROM a FULL OUTER JOIN b USING (cv_id, ocean_time)""",
        "density_full_mesh": f"""WITH {_TEF},
c AS (SELECT salt_idx, temp_idx, count(*) AS n FROM tefb WHERE salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL),
m AS (
  SELECT CAST(a AS INTEGER) AS salt_edge_idx, CAST(b AS INTEGER) AS temp_edge_idx, a * 0.5e0 AS salt, b * 1.0e0 AS temp
  FROM (SELECT unnest(range(81)) AS a) CROSS JOIN (SELECT unnest(range(41)) AS b)
)
SELECT salt_edge_idx, temp_edge_idx, salt, temp, round({rho}, 8) + 0.0e0 AS rho, coalesce(n, 0) AS n
FROM m LEFT JOIN c ON c.salt_idx = m.salt_edge_idx AND c.temp_idx = m.temp_edge_idx""",
        "density_ts": f"""WITH {_TEF}
SELECT cv_id, ocean_time, round(avg({rho}), 8) + 0.0e0 AS rho_mean, round(min({rho}), 8) + 0.0e0 AS rho_min,
  round(max({rho}), 8) + 0.0e0 AS rho_max FROM tef GROUP BY ALL""",
        "density_mesh": f"""WITH {_TEF},
b AS (SELECT salt_idx, temp_idx, CAST(count(*) AS DOUBLE) AS n FROM tefb WHERE salt_idx IS NOT NULL AND temp_idx IS NOT NULL GROUP BY ALL),
c AS (SELECT *, {_SB}, {_TB} FROM b)
SELECT salt_idx, temp_idx, salt_bin, temp_bin, n, round({rho.replace("salt", "salt_bin").replace("temp", "temp_bin")}, 8) + 0.0e0 AS rho FROM c""",
        "resample_linear": f"""WITH {hours},
dy AS (SELECT CAST(date_trunc('day', ocean_time) AS TIMESTAMP) AS t, CAST(sum(xc) AS DOUBLE) AS xc, CAST(sum(n) AS DOUBLE) AS n FROM hs GROUP BY ALL),
span AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM dy),
pr AS (SELECT s.t, a.t AS ta, a.xc AS xa, a.n AS na, b.xc AS xb, b.n AS nb
       FROM span s JOIN dy a ON a.t = date_trunc('day', s.t) LEFT JOIN dy b ON b.t = a.t + INTERVAL 1 DAY)
SELECT t AS ocean_time,
  round(CASE WHEN t = ta THEN xa ELSE xa + (xb - xa) * (epoch(t) - epoch(ta)) / 86400 END, 4) + 0.0e0 AS xc,
  round(CASE WHEN t = ta THEN na ELSE na + (nb - na) * (epoch(t) - epoch(ta)) / 86400 END, 6) + 0.0e0 AS n
FROM pr""",
        "lowpass_hann": f"""WITH {hours},
pos AS (SELECT ocean_time, n, row_number() OVER (ORDER BY ocean_time) - 1 AS pos FROM hs),
{k72}
{k75}
{f72}
{f75}
o AS (SELECT pos.ocean_time, a.n AS n72, b.n AS n75 FROM pos JOIN f72 a USING (pos) JOIN f75 b USING (pos))
SELECT ocean_time, round(n72, 8) + 0.0e0 AS n72, round(n75, 8) + 0.0e0 AS n75 FROM o""",
        "time_slices": f"WITH {hours}\n" + "\nUNION ALL\n".join(slices),
        "time_chunks": f"""WITH {_TEF},
st AS (SELECT cv_id, ocean_time, row_number() OVER (PARTITION BY cv_id ORDER BY ocean_time) - 1 AS pos FROM (SELECT DISTINCT cv_id, ocean_time FROM tef)),
ln AS (SELECT cv_id, count(*) AS len FROM st GROUP BY cv_id),
ed AS (SELECT cv_id, c, floor(c * (len / 7.0e0)) AS a, CASE WHEN c = 6 THEN len ELSE floor((c + 1) * (len / 7.0e0)) END AS b FROM ln, (SELECT unnest(range(7)) AS c))
SELECT tef.cv_id, CAST(c AS INTEGER) AS chunk_id, min(ocean_time) AS "first", max(ocean_time) AS "last", count(*) AS n, sum(q) AS q
FROM tef JOIN st USING (cv_id, ocean_time) JOIN ed ON ed.cv_id = st.cv_id AND pos >= a AND pos < b GROUP BY ALL""",
        "freq_compare": f"""WITH {hours},
r AS (
  SELECT 'hourly' AS run_id, ocean_time, CAST(xc AS DOUBLE) AS x FROM hs
  UNION ALL SELECT 'daily', CAST(date_trunc('day', ocean_time) AS TIMESTAMP) AS d, CAST(sum(xc) AS DOUBLE) FROM hs
  GROUP BY d HAVING d BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-25'
),
sp AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(ocean_time) AS lo, max(ocean_time) AS hi FROM r GROUP BY run_id))
SELECT run_id, count(*) AS n, sum(x) AS total, max(x) AS top FROM r, sp WHERE ocean_time BETWEEN lo AND hi GROUP BY run_id""",
        "positional_pairs": f"""WITH {hours}
SELECT ocean_time, xc, lead(n) OVER (ORDER BY ocean_time) AS n FROM hs QUALIFY lead(ocean_time) OVER (ORDER BY ocean_time) IS NOT NULL""",
    }


def _stored_sql() -> dict[str, str]:
    """Results that the queries write and read back."""
    net = """net AS (
  SELECT cv_id, ocean_time, salt_idx, sum({factor} * sgn * q) AS qn, sum({factor} * sgn * qs) AS qsn
  FROM tefb WHERE salt_idx IS NOT NULL GROUP BY ALL
)"""
    plain = net.format(factor="1")
    nets = f'cv_id, ocean_time, salt_idx, {_SB}, qn AS "Qnet", qsn AS "Qsnet"'
    twice = net.format(factor="(CASE WHEN year(ocean_time) = 1995 THEN 2 ELSE 1 END)")
    later = net.format(factor="(CASE WHEN year(ocean_time) = 1995 THEN 4 ELSE 1 END)")
    return {
        "daily_results": f"WITH {_TEF}, {twice} SELECT {nets}, CAST(ocean_time AS DATE) AS ocean_date FROM net",
        "monthly_results": f"""WITH {_TEF}, {plain}
SELECT {nets}, CAST(year(ocean_time) AS INTEGER) AS year, CAST(month(ocean_time) AS INTEGER) AS month FROM net
WHERE month(ocean_time) BETWEEN 6 AND 8 AND year(ocean_time) >= 1994""",
        "volume_results": f"WITH {_TEF}, {plain} SELECT {nets} FROM net WHERE cv_id IN (1, 3)",
        "chunk_results": f"""WITH {_TEF}, {plain},
st AS (SELECT cv_id, ocean_time, row_number() OVER (PARTITION BY cv_id ORDER BY ocean_time) - 1 AS pos FROM (SELECT DISTINCT cv_id, ocean_time FROM net)),
ln AS (SELECT cv_id, count(*) AS len FROM st GROUP BY cv_id)
SELECT cv_id, ocean_time, salt_idx, {_SB}, qn AS "Qnet", 2::INTEGER AS chunk_id
FROM net JOIN st USING (cv_id, ocean_time) JOIN ln USING (cv_id)
WHERE pos >= floor(2 * (len / 7.0e0)) AND pos < floor(3 * (len / 7.0e0))""",
        "versioned_results": f"""WITH {_TEF}, {plain},
v AS (SELECT unnest(['two volumes', 'all volumes']) AS description, unnest([2, 4]) AS below)
SELECT cv_id, description, 80::INTEGER AS n_bins, count(*) AS n, sum(qn) AS "Qnet" FROM net JOIN v ON cv_id < below GROUP BY ALL""",
        "redelivered_days": f"WITH {_TEF}, {later} SELECT cv_id, ocean_time, salt_idx, qn AS \"Qnet\" FROM net",
        "overlapping_files": f"""WITH {_GRID}
SELECT t AS ocean_time, count(*) AS n, sum(zeta + CASE WHEN t >= TIMESTAMP '1995-07-01' THEN 1 ELSE 0 END) AS zeta FROM col GROUP BY t""",
        "stored_columns": f"""WITH {_GRID}
SELECT t AS ocean_time, CAST(k AS INTEGER) AS k, count(salt) AS n, sum(salt) AS salt, sum(u) AS u, sum(h + zeta) AS depth FROM lev GROUP BY t, k""",
    }


def all_sql() -> dict[str, str]:
    return {**_exchange_sql(), **_histogram_sql(), **_budget_sql(), **_grid_sql(), **_face_sql(), **_series_sql(), **_stored_sql()}
