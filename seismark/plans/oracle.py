"""DuckDB SQL of the registered queries, written apart from the engine's plans."""

from __future__ import annotations

import re

CTE: dict[str, str] = {}

CTE["bars"] = """
SELECT symbol, dt, o / 1e4 AS open, CASE WHEN fl THEN c ELSE (greatest(o, c) * (1000 + (n + tc) % 5) + 500) // 1000 END / 1e4 AS high,
  CASE WHEN fl THEN c ELSE (least(o, c) * (1000 - tc % 5) + 500) // 1000 END / 1e4 AS low, c / 1e4 AS close,
  CASE WHEN (dc * 7 + tc) % 31 = 0 THEN 0 ELSE qty END AS volume
FROM (SELECT *, CASE WHEN fl THEN c ELSE (coalesce(prev, c) * (500 + greatest(-100, least(100, tc - 4 * n))) + 250) // 500 END AS o
  FROM (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY dt) AS prev, (dc + tc) % 29 = 0 AS fl
    FROM (SELECT *, CAST(round(exp(CAST(sum(greatest(-8, least(8, dc - 5 * n))) OVER (PARTITION BY symbol ORDER BY dt) AS DOUBLE) * 8e-3) * 1e6) AS BIGINT) AS c
      FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS dt, count(*)::BIGINT AS n, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS dc,
          sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS tc, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))))"""
CTE["body"] = """
SELECT symbol, dt, CASE WHEN s THEN round(open * 3e0, 4) ELSE open END AS open, CASE WHEN s THEN round(high * 3e0, 4) ELSE high END AS high,
  CASE WHEN s THEN round(low * 3e0, 4) ELSE low END AS low, CASE WHEN s THEN round(close * 3e0, 4) ELSE close END AS close, volume
FROM (SELECT *, symbol = 'Brand#22' AND dt < DATE '1996-06-03' AS s FROM bars)
WHERE NOT (symbol = 'Brand#11' AND dt BETWEEN DATE '1996-03-01' AND DATE '1996-03-25')"""
CTE["raw"] = """
SELECT *, 1 AS seq FROM body UNION ALL SELECT symbol, dt, open, high, low, (CAST(round(close * 10000) AS BIGINT) + 1) // 2 / 1e4, volume, 0 FROM body WHERE volume % 17 = 0
UNION ALL SELECT symbol, dt, open, high, low, 0e0, volume, 2 FROM body WHERE volume % 41 = 3"""
CTE["dd1"] = "SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, dt ORDER BY seq DESC) = 1"
CTE["valid"] = "SELECT * FROM dd1 WHERE open > 0 AND high > 0 AND low > 0 AND close > 0"
CTE["brk"] = """
SELECT symbol, min(dt) AS first_dt, max(CASE WHEN gap > 10 THEN dt END) AS gap_dt, count(*) FILTER (gap > 10) AS n_gaps,
  max(CASE WHEN jump > 0.5 THEN dt END) AS action_dt, count(*) FILTER (jump > 0.5) AS n_corp_actions
FROM (SELECT symbol, dt, datediff('day', lag(dt) OVER w, dt) AS gap, abs(ln(close) - lag(ln(close)) OVER w) AS jump FROM valid WINDOW w AS (PARTITION BY symbol ORDER BY dt))
GROUP BY symbol"""
CTE["cleaned"] = """
SELECT v.symbol, v.dt, open, high, low, close, volume, open = high AND high = low AND low = close AS is_flat, coalesce(volume, 0) = 0 AS is_zero_vol, false AS gap_filled
FROM valid v JOIN brk b ON v.symbol = b.symbol AND v.dt >= greatest(first_dt, coalesce(gap_dt, first_dt), coalesce(action_dt, first_dt)) WHERE v.dt <= DATE '2026-06-05'"""
CTE["cal"] = "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS pos FROM (SELECT DISTINCT dt FROM bars)"
CTE["grid"] = "SELECT symbol, dt, pos FROM cal, (SELECT DISTINCT symbol FROM bars)"
CTE["panel"] = "SELECT g.symbol, g.dt, close FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.dt = g.dt"
CTE["mask"] = "SELECT g.symbol, g.dt, g.dt BETWEEN a AND z AS is_listed FROM grid g JOIN (SELECT symbol, min(dt) AS a, max(dt) AS z FROM bars GROUP BY 1) l ON l.symbol = g.symbol"
CTE["ret"] = """
SELECT *, lc - lag(lc) OVER w AS r, row_number() OVER w AS rn, lag(close) OVER w AS pc
FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc, open = high AND high = low AND low = close AS is_flat FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY dt)"""
_OVER = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    w = _OVER.format(n - 1)
    return f"CASE WHEN count({x}) OVER {w} >= {least or n} THEN {agg}({x}) OVER {w} END"


_LAGS = ", ".join(f"lag(lc, {i}) OVER w AS y{i}" for i in range(1, 7))
CTE["sa0"] = f"""
SELECT *, 1e2 * (2 * lc + y1 - y3 - 2 * y4) / 1e1 AS slope, 1e2 * (5 * lc - 3 * y2 - 4 * y3 - 3 * y4 + 5 * y6 + 0 * y1 + 0 * y5) / 4.2e1 AS accel,
  1e2 * lag(sd60, 20) OVER w AS vol
FROM (SELECT *, {_LAGS}, {_roll('stddev_samp', 'r', 60)} AS sd60, {_roll('stddev_samp', 'r', 20)} AS sd20, {_roll('stddev_samp', 'r', 5)} AS sd5
  FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WINDOW w AS (PARTITION BY symbol ORDER BY dt)"""
CTE["sa"] = """
SELECT *, CASE WHEN slope_z IS NULL OR accel_z IS NULL THEN NULL WHEN abs(slope_z) < 0.1 OR abs(accel_z) < 0.05 THEN 'Flat'
  WHEN slope_z < 0 AND accel_z < 0 THEN 'AcceleratingDecline' WHEN slope_z < 0 THEN 'DeceleratingDecline' WHEN accel_z > 0 THEN 'AcceleratingAdvance' ELSE 'DeceleratingAdvance' END AS phase
FROM (SELECT *, CASE WHEN vol > 1e-12 THEN slope / vol END AS slope_z, CASE WHEN vol > 1e-12 THEN accel / vol END AS accel_z FROM sa0)"""
CTE["pre0"] = f"""
SELECT *, {_roll('avg', 'd2', 20)} AS dn2, {_roll('avg', 'u2', 20)} AS up2, {_roll('avg', 'lv', 60, 30)} AS lvm, {_roll('stddev_samp', 'lv', 60, 30)} AS lvs,
  {_roll('avg', 'rng', 60, 30)} AS rm, {_roll('avg', 'jmp', 20)} AS gap_freq, {_roll('avg', 'imp', 20)} AS im, {_roll('max', 'close', 60, 30)} AS top,
  {_roll('stddev_samp', 'sd20', 60)} AS vvs, {_roll('avg', 'sd20', 60)} AS vvm
FROM (SELECT *, CASE WHEN r < 0 THEN r * r ELSE 0e0 END AS d2, CASE WHEN r > 0 THEN r * r ELSE 0e0 END AS u2, CASE WHEN volume > 0 THEN ln(volume::DOUBLE) END AS lv,
  CASE WHEN NOT is_flat AND close > 1e-12 THEN (high - low) / close END AS rng, CASE WHEN pc > 1e-12 AND abs(open / pc - 1) > 0.01 THEN 1e0 ELSE 0e0 END AS jmp,
  CASE WHEN volume > 0 AND close * volume > 1e-12 THEN abs(r) / (close * volume) END AS imp FROM sa)"""
CTE["pre"] = """
SELECT symbol, dt, 1e2 * r AS ret_1d, 1e2 * sd5 AS vol_short, 1e2 * sd60 AS vol_long, CASE WHEN sd60 > 1e-12 THEN sd5 / sd60 END AS vol_ratio,
  CASE WHEN vvm > 1e-12 THEN vvs / vvm END AS vol_of_vol, CASE WHEN sqrt(dn2) + sqrt(up2) > 1e-12 THEN (sqrt(dn2) - sqrt(up2)) / (sqrt(dn2) + sqrt(up2)) END AS semidev_asym,
  CASE WHEN lvs > 1e-12 THEN (lv - lvm) / lvs END AS volume_z, CASE WHEN rm > 1e-12 THEN rng / rm END AS range_expansion, gap_freq,
  CASE WHEN im > 0 THEN ln(im) END AS illiquidity, CASE WHEN top > 1e-12 THEN close / top - 1 END AS dd_from_high, slope_z, accel_z, phase, vol FROM pre0"""
CTE["proxy"] = "SELECT *, abs(slope_z) + abs(vol_ratio - 1) AS score FROM pre"
CTE["train"] = "SELECT symbol, score FROM proxy WHERE dt BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND score IS NOT NULL"
CTE["scored"] = """
SELECT p.*, CASE WHEN score IS NOT NULL THEN (sum(t) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / (SELECT count(*) FROM train) END AS intensity, t
FROM (SELECT *, 0 AS t FROM proxy UNION ALL SELECT * REPLACE (score AS score), 1 FROM proxy WHERE dt BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND score IS NOT NULL) p
QUALIFY t = 0"""
CTE["sc"] = "SELECT * EXCLUDE (t) FROM (SELECT * FROM scored) WHERE t = 0"
CTE["banded"] = "SELECT *, CASE WHEN intensity >= 0.99 THEN 'High' WHEN intensity >= 0.95 THEN 'Moderate' WHEN intensity >= 0.9 THEN 'Low' ELSE 'None' END AS band FROM sc"
CTE["reg0"] = f"SELECT *, ({_roll('sum', 'r', 20)}) / 20 * 100 AS ppd, ({_roll('stddev_samp', 'r', 252, 63)}) * sqrt(252e0) AS hv FROM ret"
CTE["rega"] = """
SELECT symbol, dt, ppd, CASE WHEN ppd IS NULL THEN 'Sideways' WHEN ppd >= 0.2 - 1e-9 THEN 'Rally' WHEN ppd >= 0.05 - 1e-9 THEN 'Rising' WHEN ppd <= -0.2 + 1e-9 THEN 'Crashing' WHEN ppd <= -0.05 + 1e-9 THEN 'Falling' ELSE 'Sideways' END AS regime, hv FROM reg0"""
CTE["frame"] = "SELECT s.*, regime FROM sc s JOIN rega r ON r.symbol = s.symbol AND r.dt = s.dt"
CTE["inp"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, coalesce(intensity >= 0.99 AND phase = 'AcceleratingDecline', false) AS sev,
  coalesce(intensity >= 0.95 AND intensity < 0.99, false) AND coalesce(phase, '') <> 'AcceleratingAdvance' AS mld,
  coalesce(CASE WHEN vol > 0 THEN ret_1d / vol END, 0) < coalesce(slope_z, 0) - 1e-9 AND regime IN ('Crashing', 'Falling') AND coalesce(slope_z, 0) < -1e-9 AS conf,
  CASE WHEN abs(slope_z) > 1e-9 THEN slope_z ELSE 0 END AS sl, coalesce(phase, '') <> 'AcceleratingDecline' AS ree FROM frame"""
# h0, w0: state before the bar; h, s, w: after it
_STEP = """
CASE WHEN NOT {h} THEN CASE WHEN {s} + 1 > 3 AND (ree OR {s} + 1 >= 20) THEN 'ENTER' ELSE '' END WHEN sev AND {s} + 1 > 3 THEN 'EXIT'
  WHEN {w} > 0 AND conf AND {s} + 1 > 3 THEN 'EXIT_WATCH' ELSE '' END"""
_NEXT = """
SELECT symbol, dt, rn, sev, ree, h0, w0, action, CASE WHEN action = 'ENTER' THEN true WHEN action <> '' THEN false ELSE h0 END AS h, CASE WHEN action <> '' THEN 0 ELSE s0 + 1 END AS s,
  CASE WHEN NOT h0 THEN w0 WHEN action <> '' THEN 0 WHEN w0 > 0 THEN CASE WHEN sl > 0 THEN 0 ELSE w0 - 1 END WHEN mld THEN 5 ELSE w0 END AS w FROM """
CTE["sigrec"] = (
    _NEXT + "(SELECT *, true AS h0, 10000 AS s0, 0 AS w0, " + _STEP.format(h="true", s="10000", w="0") + " AS action FROM inp WHERE rn = 1) UNION ALL "
    + _NEXT + "(SELECT i.*, p.h AS h0, p.s AS s0, p.w AS w0, " + _STEP.format(h="p.h", s="p.s", w="p.w").replace("sev", "i.sev").replace("ree", "i.ree")
    + " AS action FROM sigrec p JOIN inp i ON i.symbol = p.symbol AND i.rn = p.rn + 1)"
)
CTE["sig"] = "SELECT symbol, dt, sev AS exit_signal, w0 > 0 AS watching, ree AS reentry_ok, h0 AS in_position, action FROM sigrec"
_REENTRY = {
    "rally_signal": "coalesce(intensity >= 0.95 AND phase = 'AcceleratingAdvance', false)", "decel": "coalesce(phase = 'DeceleratingDecline', false)",
    "time": "true", "not_declining": "coalesce(phase, '') <> 'AcceleratingDecline'",
}
for _rule, _mask in _REENTRY.items():
    CTE[f"in{_rule}"] = CTE["inp"].replace(_REENTRY["not_declining"] + " AS ree", _mask + " AS ree").replace("FROM frame", "FROM (SELECT * FROM frame QUALIFY count(*) OVER (PARTITION BY symbol) >= 250) f250")
    CTE[f"rec{_rule}"] = re.sub(r"\binp\b", f"in{_rule}", re.sub(r"\bsigrec\b", f"rec{_rule}", CTE["sigrec"]))
CTE["lab"] = """
SELECT symbol, dt, rn - 1 AS pos, fwd_dd, fwd_up, coalesce(fwd_dd <= -0.1, false) AS is_crash, coalesce(fwd_up >= 0.1, false) AS is_rally
FROM (SELECT *, min(close) OVER f / close - 1 AS fwd_dd, max(close) OVER f / close - 1 AS fwd_up FROM ret WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
CTE["labindex"] = "SELECT symbol, dt, pos, symbol = 'Brand#1' AND coalesce(fwd_dd <= -0.05, false) AS is_index FROM lab"
for _k in ("crash", "rally", "index"):
    CTE[f"{_k}f"] = f"SELECT symbol, dt, pos FROM {'labindex' if _k == 'index' else 'lab'} WHERE is_{_k}"
    CTE[f"{_k}on"] = (
        f"SELECT symbol, min(pos) AS pos FROM {_k}f GROUP BY symbol UNION ALL "
        f"SELECT o.symbol, (SELECT min(f.pos) FROM {_k}f f WHERE f.symbol = o.symbol AND f.pos >= o.pos + 10) AS pos FROM {_k}on o WHERE o.pos IS NOT NULL"
    )
    CTE[f"{_k}o"] = f"SELECT f.symbol, f.dt FROM {_k}on o JOIN {_k}f f ON f.symbol = o.symbol AND f.pos = o.pos"
CTE["alerts"] = "SELECT symbol, dt FROM sc WHERE intensity >= 0.95"
CTE["leads"] = """
SELECT o.symbol, o.dt, max(c.pos - a.pos) AS lead FROM crasho o JOIN cal c ON c.dt = o.dt
LEFT JOIN (SELECT symbol, pos FROM alerts JOIN cal USING (dt)) a ON a.symbol = o.symbol AND a.pos BETWEEN c.pos - 15 AND c.pos GROUP BY 1, 2"""
CTE["falses"] = """
SELECT a.symbol, a.dt FROM alerts a JOIN cal c ON c.dt = a.dt WHERE NOT EXISTS
  (SELECT 1 FROM crasho o JOIN cal d ON d.dt = o.dt WHERE o.symbol = a.symbol AND d.pos BETWEEN c.pos AND c.pos + 15)"""
CTE["pr"] = "SELECT *, CASE WHEN close > 0 THEN ln(close) END - lag(CASE WHEN close > 0 THEN ln(close) END) OVER (PARTITION BY symbol ORDER BY dt) AS r FROM panel"


def _market(name: str, corr: int, ma: int, least: int) -> None:
    """The correlation and market tables, for windows of ``corr`` and ``ma`` rows and at least ``least`` symbols."""
    CTE[f"corr{name}"] = f"""
SELECT s.dt, CASE WHEN n >= {least} AND abs(s1 * s1 - s2) > 1e-12 AND var_p IS NOT NULL THEN greatest(-1e0, least(1e0, (n * n * var_p - s2) / (s1 * s1 - s2))) END AS avg_corr
FROM (SELECT dt, coalesce(sum(s), 0) AS s1, coalesce(sum(s * s), 0) AS s2, count(s) AS n FROM (SELECT dt, {_roll('stddev_samp', 'r', corr)} AS s FROM pr) GROUP BY dt) s
JOIN (SELECT dt, CASE WHEN count(p) OVER w >= {corr} THEN var_samp(p) OVER w END AS var_p FROM (SELECT dt, avg(r) AS p FROM pr GROUP BY dt)
  WINDOW w AS (ORDER BY dt ROWS BETWEEN {corr - 1} PRECEDING AND CURRENT ROW)) p ON p.dt = s.dt"""
    columns = {"breadth_decline": "bd", "breadth_advance": "ba", "median_slope_z": "ms", "dispersion": "di", "avg_corr": "avg_corr", "pct_below_ma50": "pb"}
    floor = ", ".join(f"CASE WHEN n_live >= {least} THEN {v} END AS {k}" for k, v in columns.items())
    CTE[f"mk{name}"] = f"""
SELECT dt, n_live, {floor}
FROM (SELECT p.dt, count(phase) AS n_live, 1e2 * count(*) FILTER (phase = 'AcceleratingDecline') / nullif(count(phase), 0) AS bd, 1e2 * count(*) FILTER (phase = 'AcceleratingAdvance') / nullif(count(phase), 0) AS ba,
    quantile_cont(slope_z, 0.5) AS ms, 1e2 * stddev_samp(p.r) AS di, 1e2 * count(*) FILTER (close < ma) / nullif(count(*) FILTER (close IS NOT NULL AND ma IS NOT NULL), 0) AS pb
  FROM (SELECT *, {_roll('avg', 'close', ma)} AS ma FROM pr) p LEFT JOIN (SELECT symbol, dt, phase, slope_z FROM sa) f ON f.symbol = p.symbol AND f.dt = p.dt GROUP BY p.dt) JOIN corr{name} USING (dt)"""


_market("", 5, 5, 5)
_market("full", 60, 50, 12)
CTE["sret"] = "SELECT symbol, dt, close / pc - 1 AS ret FROM ret"
CTE["hret"] = "SELECT r.*, coalesce(in_position, true) AS held, coalesce(action, '') AS action FROM sret r LEFT JOIN sig s ON s.symbol = r.symbol AND s.dt = r.dt"
CTE["eqw"] = """
SELECT dt, exp(sum(ln(1 + d)) OVER (ORDER BY dt)) AS equity FROM (SELECT dt, coalesce(avg(CASE WHEN held THEN ret WHEN ret IS NOT NULL THEN 0 END), 0) AS d FROM hret GROUP BY dt)"""
CTE["ddc"] = "SELECT dt, equity, equity / max(equity) OVER (ORDER BY dt) - 1 AS dd FROM eqw"
CTE["btin"] = """
SELECT b.symbol, b.dt, close, coalesce(in_position, true) AS want, greatest(coalesce(vol_ratio, 1), 0) AS vr, row_number() OVER (PARTITION BY b.symbol ORDER BY b.dt) AS rn
FROM bars b LEFT JOIN sig s ON s.symbol = b.symbol AND s.dt = b.dt LEFT JOIN pre p ON p.symbol = b.symbol AND p.dt = b.dt WHERE close > 0"""
_SLIP = "least(5e-4 * (1 + greatest(vr - 1, 0)), 1e-2)"
_COST = "{q} * {p} * ((CASE WHEN dt >= DATE '2024-10-01' THEN 2.97e-5 ELSE 3.25e-5 END + 1e-6) * 1.18e0 + 1e-3)"
CTE["btm"] = f"SELECT *, close * (1 + {_SLIP}) AS bp, close * (1 - {_SLIP}) AS sp FROM btin"
_BT = f"""
SELECT symbol, dt, rn, CASE WHEN sell THEN 'sell' WHEN buy THEN 'buy' END AS side, CASE WHEN sell THEN held0 WHEN buy THEN nq END AS qty, CASE WHEN sell THEN sp WHEN buy THEN bp END AS price,
  CASE WHEN sell THEN {_COST.format(q='held0', p='sp')} + 1.534e1 WHEN buy THEN bcost END AS total_cost,
  CASE WHEN sell THEN cash0 + sp * held0 - ({_COST.format(q='held0', p='sp')} + 1.534e1) WHEN buy THEN cash0 - bp * nq - bcost ELSE cash0 END AS cash,
  CASE WHEN sell THEN 0 WHEN buy THEN nq ELSE held0 END AS held, CASE WHEN sell THEN (sp - paid0) * held0 END AS gain, CASE WHEN buy THEN bp ELSE paid0 END AS paid,
  CASE WHEN sell THEN since0 END AS bought, CASE WHEN buy THEN dt ELSE since0 END AS since
FROM (SELECT *, held0 > 0 AND NOT want AS sell, held0 = 0 AND want AND cash0 > 0 AND nq > 0 AND bp * nq + bcost <= cash0 AS buy
  FROM (SELECT *, {_COST.format(q='nq', p='bp')} + nq * bp * 1.5e-4 AS bcost FROM (SELECT *, CAST(floor(cash0 * 9.95e-1 / bp) AS BIGINT) AS nq FROM {{}})))"""
CTE["btrec"] = (
    _BT.format("(SELECT *, 1e6 / (SELECT count(DISTINCT symbol) FROM bars) AS cash0, 0::BIGINT AS held0, 0e0 AS paid0, NULL::DATE AS since0 FROM btm WHERE rn = 1)")
    + " UNION ALL " + _BT.format("(SELECT m.*, p.cash AS cash0, p.held AS held0, p.paid AS paid0, p.since AS since0 FROM btrec p JOIN btm m ON m.symbol = p.symbol AND m.rn = p.rn + 1)")
)
CTE["real"] = "SELECT symbol, dt AS sold_on, qty, gain, datediff('day', bought, dt) AS holding_days FROM btrec WHERE side = 'sell'"
CTE["tax"] = """
SELECT fy, st AS stcg_gain, lt AS ltcg_gain, greatest(st, 0) * CASE WHEN a >= DATE '2024-07-23' THEN 0.2e0 ELSE 0.15e0 END
  + greatest(lt - CASE WHEN a >= DATE '2024-07-23' THEN 125000 ELSE 100000 END, 0) * CASE WHEN a >= DATE '2024-07-23' THEN 0.125e0 ELSE 0.1e0 END AS tax
FROM (SELECT CASE WHEN month(sold_on) >= 4 THEN year(sold_on) ELSE year(sold_on) - 1 END AS fy, max(sold_on) AS a, sum(CASE WHEN holding_days < 365 THEN gain ELSE 0e0 END) AS st,
  sum(CASE WHEN holding_days >= 365 THEN gain ELSE 0e0 END) AS lt FROM real GROUP BY 1)"""
CTE["taxall"] = CTE["tax"].replace("FROM real", "FROM (SELECT sold_on, gain, holding_days FROM real UNION ALL SELECT sold_on, gain, holding_days FROM lots) sales")
CTE["lots"] = """
SELECT r.symbol, z AS sold_on, r.held AS qty, (close - paid) * r.held AS gain, datediff('day', since, z) AS holding_days
FROM (SELECT * FROM btrec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1) r, (SELECT max(dt) AS z FROM bars)
JOIN bars b ON b.symbol = r.symbol AND b.dt = z WHERE r.held > 0"""
CTE["beq"] = """
SELECT dt, sum(cash + held * lc) AS equity FROM (SELECT g.dt, coalesce(last_value(cash IGNORE NULLS) OVER w, 1e6 / (SELECT count(DISTINCT symbol) FROM bars)) AS cash,
  coalesce(last_value(held IGNORE NULLS) OVER w, 0) AS held, coalesce(last_value(close IGNORE NULLS) OVER w, 0) AS lc
  FROM panel g LEFT JOIN btrec t ON t.symbol = g.symbol AND t.dt = g.dt WINDOW w AS (PARTITION BY g.symbol ORDER BY g.dt ROWS UNBOUNDED PRECEDING)) GROUP BY dt"""
CTE["refit"] = "SELECT as_of, coalesce(lead(as_of) OVER (ORDER BY as_of), DATE '2001-01-01') AS block_end FROM (SELECT min(dt) AS as_of FROM cal WHERE dt BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY date_trunc('month', dt))"
CTE["bysym"] = """
SELECT symbol, dt, exp(sum(ln(1 + CASE WHEN held THEN x ELSE 0 END)) OVER w) AS s, exp(sum(ln(1 + x)) OVER w) AS b, held, action FROM
  (SELECT *, coalesce(ret, 0) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM hret) WHERE n >= 250 WINDOW w AS (PARTITION BY symbol ORDER BY dt)"""
CTE["ddsym"] = """
SELECT symbol, min(sd) AS sdd, min(bd) AS bdd, count(*) FILTER (sd < -1e-9) AS us, count(*) FILTER (bd < -1e-9) AS ub, max_by(s, dt) - 1 AS rs, max_by(b, dt) - 1 AS rb,
  count(*) FILTER (action IN ('EXIT', 'EXIT_WATCH')) AS exits, 1e2 * (1 - avg(CASE WHEN held THEN 1e0 ELSE 0e0 END)) AS pc
FROM (SELECT *, s / max(s) OVER w - 1 AS sd, b / max(b) OVER w - 1 AS bd FROM bysym WINDOW w AS (PARTITION BY symbol ORDER BY dt)) GROUP BY symbol"""

_RECURSIVE = ("sigrec", "crashon", "rallyon", "indexon", "btrec", *(f"rec{r}" for r in _REENTRY))


def with_ctes(sql: str) -> str:
    """``sql`` under a WITH clause of all the parts it needs, in order."""
    need: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in CTE:
            if name not in need and name not in above and re.search(rf"\b(FROM|JOIN|,)\s+\(?{name}\b(?!\s*\()", text):
                visit(CTE[name], (*above, name))
                need.append(name)

    visit(sql, ())
    parts = ", ".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({CTE[n]})" for n in need)
    return f"WITH RECURSIVE {parts} {sql}" if need else sql
