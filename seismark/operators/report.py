"""Report tables and a self-contained HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.config import SignalConfig
from seismark.functions.scalars import is_sell
from seismark.operators import drawdown


def anomaly_days(scored: DataFrame, signals: DataFrame, c: SignalConfig = SignalConfig()) -> DataFrame:
    """Every day at or above the moderate intensity, with what was seen and done."""
    d = scored.join(signals.select("symbol", "dt", "in_position", "watching", "action"), ["symbol", "dt"], "left").filter(F.col("intensity") >= c.moderate_intensity)
    action = (
        F.when(F.col("action") == "EXIT", "SELL").when(F.col("action") == "EXIT_WATCH", "SELL (from watch)").when(F.col("action") == "ENTER", "BUY")
        .when(~F.coalesce("in_position", F.lit(True)), "already out").when(F.coalesce("watching", F.lit(False)), "watching").otherwise("no action")
    )
    severity = F.when(F.col("intensity") >= c.exit_intensity, "Severe").otherwise("Mild")
    return d.select("symbol", "dt", F.round("intensity", 4).alias("intensity"), severity.alias("severity"), F.round("slope_z", 2).alias("slope"), F.round("accel_z", 2).alias("accel"), F.col("phase").alias("trend"), action.alias("action"))


def dashboard_payload(bars: DataFrame, scored: DataFrame, signals: DataFrame) -> DataFrame:
    """Per symbol: sessions, first and last date, last close, exits, share in cash, anomaly days."""
    d = bars.join(scored.select("symbol", "dt", "intensity"), ["symbol", "dt"], "left").join(signals.select("symbol", "dt", "in_position", "action"), ["symbol", "dt"], "left")
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.round(F.max_by("close", "dt"), 2).alias("last_close"),
        F.count_if(F.col("action").isin("EXIT", "EXIT_WATCH")).alias("exits"),
        F.round((1 - F.avg(F.coalesce("in_position", F.lit(True)).cast("double"))) * 100, 4).alias("pct_in_cash"), F.count_if(F.col("intensity") >= 0.95).alias("anomaly_days"),
    )


def check_consistent(*counts: int, most: int = 2) -> None:
    if max(counts) - min(counts) > most:
        raise ValueError(f"tables disagree on the number of symbols: {counts}")


def portfolio_chart(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """dt, both equity curves and both drawdowns, for every session that both curves have."""
    curve = lambda df, name: drawdown.series(df).select("dt", F.col("equity").alias(name), F.col("dd").alias(f"{name}_dd"))
    return curve(strategy, "strategy").join(curve(benchmark, "benchmark"), "dt")


def scatter_chart(table: DataFrame) -> DataFrame:
    """symbol, x (buy and hold) and y (strategy) drawdown in per cent, and the side: shallower, deeper or unchanged."""
    x, y = F.col("bh_max_drawdown") * 100, F.col("strategy_max_drawdown") * 100
    side = F.when(y - x > 0.1, "shallower").when(y - x < -0.1, "deeper").otherwise("unchanged")
    return table.select("symbol", x.alias("x"), y.alias("y"), side.alias("side"))


def symbol_chart(bars: DataFrame, signals: DataFrame, crashes: DataFrame) -> DataFrame:
    """symbol, dt, close, in_cash, marker (SELL or BUY) and is_onset of every bar."""
    d = bars.select("symbol", "dt", "close").join(signals.select("symbol", "dt", "in_position", "action"), ["symbol", "dt"], "left")
    d = d.join(crashes.select("symbol", "dt", F.lit(True).alias("onset")), ["symbol", "dt"], "left")
    marker = F.when(is_sell(F.col("action")), "SELL").when(F.col("action") == "ENTER", "BUY")
    return d.select("symbol", "dt", "close", (~F.coalesce("in_position", F.lit(True))).alias("in_cash"), marker.alias("marker"), F.coalesce("onset", F.lit(False)).alias("is_onset"))


def scheme_chart(curves: dict[str, DataFrame]) -> DataFrame:
    """scheme, dt, equity, dd of each curve, one below the other."""
    out = None
    for name, df in curves.items():
        one = drawdown.series(df).select(F.lit(name).alias("scheme"), "dt", "equity", "dd")
        out = one if out is None else out.unionByName(one)
    return out


COLOURS = ("#3366cc", "#999999", "#2e8b57", "#b03030", "#b8860b")


def svg(series: dict[str, list[tuple[float, float]]], kind: str = "line", width: int = 640, height: int = 200) -> str:
    """An inline SVG of named series of points: lines, or dots."""
    points = [p for s in series.values() for p in s]
    if not points:
        return "<svg/>"
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    place = lambda x, y: f"{(x - x0) / ((x1 - x0) or 1.0) * width:.1f},{height - (y - y0) / ((y1 - y0) or 1.0) * height:.1f}"
    parts = []
    for k, (name, held) in enumerate(series.items()):
        colour, label = COLOURS[k % len(COLOURS)], f"<title>{html.escape(name)}</title>"
        if kind == "line":
            parts.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(place(*p) for p in held)}">{label}</polyline>')
        else:
            spots = (place(*p).split(",") for p in held)
            parts.append(f'<g fill="{colour}">{label}' + "".join(f'<circle r="3" cx="{a}" cy="{b}"/>' for a, b in spots) + "</g>")
    return f'<svg viewBox="0 0 {width} {height}">{"".join(parts)}</svg>'


def percent(v: float | None, digits: int = 2) -> str:
    return "–" if v is None else f"{v * 100:.{digits}f}%"


def rupees(v: float | None) -> str:
    return "–" if v is None else f"Rs {v:,.0f}"


def tile(label: str, value: str, note: str = "") -> str:
    """A figure with its name."""
    return f"<div class=tile><b>{html.escape(value)}</b><span>{html.escape(label)}</span><small>{html.escape(note)}</small></div>"


def callout(title: str, body: str, tone: str = "") -> str:
    return f'<aside class="{html.escape(tone)}"><b>{html.escape(title)}</b> {html.escape(body)}</aside>'


def table_html(name: str, df: DataFrame, rows: int = 500) -> str:
    """A table of the first ``rows`` rows by its columns' order; a longer one says how many there are."""
    found = df.orderBy(*df.columns).limit(rows + 1).collect()
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in found[:rows])
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    rest = f"<p>The first {rows} of {df.count()} rows.</p>" if len(found) > rows else ""
    return f"<h3>{html.escape(name)}</h3>{rest}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


#: Sorts a table by the heading clicked, and hides rows without the text typed.
_SCRIPT = """
document.querySelectorAll('th').forEach(h => h.onclick = () => {
  const body = h.closest('table').tBodies[0], i = h.cellIndex, up = h.dataset.up = h.dataset.up === '1' ? '0' : '1';
  const key = r => { const t = r.cells[i].textContent; return isNaN(t) || t === '' ? t : Number(t); };
  [...body.rows].sort((a, b) => (key(a) > key(b) ? 1 : -1) * (up === '1' ? 1 : -1)).forEach(r => body.append(r));
});
document.querySelector('#find').oninput = e => document.querySelectorAll('tbody tr').forEach(r => r.hidden = !r.textContent.toLowerCase().includes(e.target.value.toLowerCase()));
"""


def html_page(title: str, tabs: dict[str, list[str]], payload: dict | None = None) -> str:
    """One self-contained page: a heading, a search field, and a section for each tab of ready parts."""
    links = " ".join(f'<a href="#t{k}">{html.escape(t)}</a>' for k, t in enumerate(tabs))
    body = "".join(f'<section id="t{k}"><h2>{html.escape(t)}</h2>{"".join(held)}</section>' for k, (t, held) in enumerate(tabs.items()))
    data = json.dumps(payload or {}, default=str).replace("</", "<\\/")
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><nav>{links} <input id=find></nav>"
        f"{body}<script type='application/json' id=data>{data}</script><script>{_SCRIPT}</script>"
    )


def dashboard(title: str, summary: dict, portfolio: DataFrame, schemes: DataFrame, scheme_curves: DataFrame, symbols: DataFrame, anomalies: DataFrame, payload: DataFrame) -> str:
    """The five tabs: overview, schemes, portfolio, symbols and explorer. All but the anomalies are small tables.

    ``summary``: cagr, max_drawdown, trades, costs and tax_paid of the run.
    Tables that disagree on the number of symbols are refused.
    """
    check_consistent(symbols.select("symbol").distinct().count(), payload.select("symbol").distinct().count())
    days = portfolio.orderBy("dt").collect()  # one row per date
    line = lambda name: [(float(k), float(r[name])) for k, r in enumerate(days)]
    by_scheme: dict[str, list[tuple[float, float]]] = {}
    for r in scheme_curves.orderBy("scheme", "dt").collect():
        held = by_scheme.setdefault(r.scheme, [])
        held.append((float(len(held)), float(r.equity)))
    spots: dict[str, list[tuple[float, float]]] = {}
    for r in scatter_chart(symbols).collect():  # one row per symbol
        spots.setdefault(r.side, []).append((r.x, r.y))
    tiles = [
        tile("growth a year", percent(summary.get("cagr"))), tile("deepest fall", percent(summary.get("max_drawdown"))), tile("trades", str(summary.get("trades", 0))),
        tile("costs", rupees(summary.get("costs"))), tile("tax", rupees(summary.get("tax_paid"))),
    ]
    tabs = {
        "Overview": [*tiles, callout("Read with care", "what was measured on past sessions need not hold for others")],
        "Schemes": [svg(by_scheme), table_html("retraining schemes", schemes)],
        "Portfolio": [svg({"strategy": line("strategy"), "buy and hold": line("benchmark")}), svg({"strategy": line("strategy_dd"), "buy and hold": line("benchmark_dd")})],
        "Symbols": [svg(spots, "dots"), table_html("drawdown by symbol", symbols)],
        "Explorer": [table_html("anomaly days", anomalies)],
    }
    return html_page(title, tabs, {"symbols": [r.asDict() for r in payload.collect()]})
