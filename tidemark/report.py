"""The report: a page without outside parts, tables as CSV, a summary as JSON. Small results only."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

WIDTH, HEIGHT, PAD = 640, 240, 36
ROWS = 40
#: Columns whose curves are drawn.
STRATA = 3
STYLE = "body{font:15px/1.5 system-ui;max-width:960px;margin:2em auto;padding:0 1em;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{border-bottom:1px solid #ddd;padding:.25em .6em;text-align:left}.BLOCK{color:#a11}.WARN{color:#a60}.tile{display:inline-block;margin:0 1.5em 1em 0}.tile b{display:block;font-size:1.5em}svg{background:#fafafa;margin:.5em 0}"


def shown(value: Any) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:,.4g}"
    return str(value)


def percent(value: float | None) -> str:
    return "–" if value is None else f"{100 * value:.1f} %"


def rows_of(df: DataFrame | list[dict] | None, limit: int = ROWS) -> list[dict]:
    if df is None:
        return []
    return df[:limit] if isinstance(df, list) else [r.asDict() for r in df.limit(limit).collect()]


def table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    body = "".join("<tr" + (f' class="{r["level"]}"' if r.get("level") in ("BLOCK", "WARN") else "") + ">" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def _scale(values: list[float], low: float, high: float, flip: bool = False):
    least, most = min(values), max(values)
    span = (most - least) or 1.0
    return lambda v: (high - (v - least) / span * (high - low)) if flip else (low + (v - least) / span * (high - low))


def _svg(parts: list[str], title: str, height: int = HEIGHT) -> str:
    return f'<svg width="{WIDTH}" height="{height}" role="img" aria-label="{html.escape(title)}"><text x="{PAD}" y="18" font-size="13">{html.escape(title)}</text>{"".join(parts)}</svg>'


def line(xs: list[float], series: dict[str, list[float]], title: str, steps: bool = False, band: tuple[list[float], list[float]] | None = None) -> str:
    """Lines or steps over a common x, with an optional band."""
    everything = [v for ys in series.values() for v in ys] + [*(band[0] if band else ()), *(band[1] if band else ()), 0.0]
    if len(xs) < 2:
        return ""
    px, py = _scale(xs, PAD, WIDTH - PAD), _scale(everything, PAD, HEIGHT - PAD, True)
    parts = []
    if band:
        ring = [f"{px(x):.1f},{py(v):.1f}" for x, v in zip(xs, band[1], strict=True)] + [f"{px(x):.1f},{py(v):.1f}" for x, v in zip(reversed(xs), reversed(band[0]), strict=True)]
        parts.append(f'<polygon points="{" ".join(ring)}" fill="#bcd" opacity=".5"/>')
    for i, (name, ys) in enumerate(series.items()):
        color = ("#246", "#b52", "#282", "#828", "#888")[i % 5]
        points = []
        for j, (x, v) in enumerate(zip(xs, ys, strict=True)):
            if steps and j:
                points.append(f"{px(x):.1f},{py(ys[j - 1]):.1f}")
            points.append(f"{px(x):.1f},{py(v):.1f}")
        parts.append(f'<polyline points="{" ".join(points)}" fill="none" stroke="{color}" stroke-width="2"/><text x="{WIDTH - PAD - 110}" y="{PAD + 14 * i}" font-size="12" fill="{color}">{html.escape(name)}</text>')
    return _svg(parts, title)


def bars(names: list[str], values: list[float], title: str) -> str:
    """Horizontal bars from zero."""
    if not names:
        return ""
    height = PAD + 22 * len(names) + 8
    px = _scale([0.0, *values], 250, WIDTH - PAD)
    parts = []
    for i, (n, v) in enumerate(zip(names, values, strict=True)):
        a, b = sorted((px(0.0), px(v)))
        parts.append(f'<rect x="{a:.1f}" y="{PAD + 22 * i}" width="{max(b - a, 0.5):.1f}" height="15" fill="#468"/><text x="244" y="{PAD + 12 + 22 * i}" font-size="12" text-anchor="end">{html.escape(n[-38:])}</text>')
    return _svg(parts, title, height)


def forest(names: list[str], middles: list[float], lows: list[float], highs: list[float], title: str) -> str:
    """Estimates with their intervals around zero."""
    if not names:
        return ""
    px = _scale([0.0, *lows, *highs], 250, WIDTH - PAD)
    height = PAD + 24 * len(names) + 8
    parts = [f'<line x1="{px(0.0):.1f}" x2="{px(0.0):.1f}" y1="{PAD - 8}" y2="{height - 6}" stroke="#999"/>']
    for i, (n, m, a, b) in enumerate(zip(names, middles, lows, highs, strict=True)):
        y = PAD + 8 + 24 * i
        parts.append(f'<line x1="{px(a):.1f}" x2="{px(b):.1f}" y1="{y}" y2="{y}" stroke="#246" stroke-width="2"/><circle cx="{px(m):.1f}" cy="{y}" r="4" fill="#246"/><text x="244" y="{y + 4}" font-size="12" text-anchor="end">{html.escape(n)}</text>')
    return _svg(parts, title, height)


def page(title: str, sections: list[tuple[str, str]]) -> str:
    inner = "".join(f"<h2>{html.escape(h)}</h2>{b}" for h, b in sections if b)
    return f'<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style><h1>{html.escape(title)}</h1>{inner}</html>'


def notes(listed: list[str]) -> str:
    return "<ul>" + "".join(f"<li>{html.escape(n)}</li>" for n in listed) + "</ul>" if listed else ""


def build(run: Any) -> str:
    """run: a plans.pipeline.Run."""
    tiles = "".join(f'<span class="tile"><b>{shown(v)}</b>{html.escape(k)}</span>' for k, v in run.summary.items() if isinstance(v, (int, float, str)))
    by = rows_of(run.by_date.orderBy("snapshot_date"), 400)
    findings = [{"level": f.level, "code": f.code, "finding": f.message, "columns": ", ".join(f.columns[:8])} for f in run.report.ordered()]
    rate = line([float(i) for i in range(len(by))], {"rate": [r["churn_rate"] or 0.0 for r in by]}, "Event rate by prediction date")
    sections = [("Overview", tiles), ("Integrity", table(findings)), ("Panel", rate + table(by))]
    if run.fitted:
        sections.append(("Model", _model(run)))
    if run.drivers is not None:
        top = rows_of(run.drivers.orderBy("rank"), 20)
        sections.append(("Drivers", bars([r["feature"] for r in top], [r["importance"] for r in top], "Importance") + table(top)))
        if run.profiles is not None:
            sections.append(("Profiles", table(rows_of(run.profiles, 120))))
    if run.effects:
        sections.append(("Effects", _effects(run.effects)))
    if run.experiment:
        sections.append(("Experiment", table(run.experiment.results) + table(run.experiment.checks) + notes(run.experiment.notes)))
    if run.curve is not None:
        sections.append(("Survival", _survival(run)))
    sections.append(("Notes", notes(run.notes)))
    return page("Retention report", sections)


def _model(run: Any) -> str:
    cal, lift = rows_of(run.calibration.orderBy("bin")), rows_of(run.deciles.orderBy("decile"))
    predicted = [r["mean_predicted"] for r in cal]
    both = table([{"model": "trees"} | run.fitted.metrics, {"model": "logistic"} | run.fitted.baseline])
    curve = line(predicted, {"observed": [r["observed"] for r in cal], "predicted": predicted}, "Calibration")
    return both + curve + bars([str(r["decile"] + 1) for r in lift], [r["rate"] for r in lift], "Event rate by risk decile") + table(run.fitted.cv)


def _effects(effects: list) -> str:
    good = [e for e in effects if e.valid and e.ci]
    rows = [{"treatment": e.treatment, "verdict": e.verdict, "effect": e.ate, "p": e.p_value, "naive": e.naive, "overlap": e.overlap, "notes": "; ".join(e.notes)} for e in effects]
    return forest([e.treatment for e in good], [e.ate for e in good], [e.ci[0] for e in good], [e.ci[1] for e in good], "Average effect") + table(rows)


def _survival(run: Any) -> str:
    """The curve of all, one chart for each of the first strata columns, the log-rank tests and the Cox table."""
    c = rows_of(run.curve.orderBy("t"), 5000)
    out = line([float(r["t"]) for r in c], {"survival": [r["survival"] for r in c]}, "Survival", True, ([r["ci_low"] for r in c], [r["ci_high"] for r in c]))
    for column, curves in list(run.strata.items())[:STRATA]:
        by: dict[str, list] = {}
        for r in rows_of(curves.orderBy(column, "t"), 40_000):
            by.setdefault(str(r[column]), []).append(r)
        days = sorted({float(r["t"]) for rows in by.values() for r in rows})
        out += line(days, {k: _steps(rows, days) for k, rows in by.items()}, f"Survival by {column}", True)
    return out + (table(run.logrank) if run.logrank else "") + table(run.cox.table() if run.cox else [])


def _steps(rows: list[dict], days: list[float]) -> list[float]:
    """A curve's value on each of the days: that of its last time so far, 1 before the first."""
    out, value, at = [], 1.0, 0
    for d in days:
        while at < len(rows) and rows[at]["t"] <= d:
            value, at = rows[at]["survival"], at + 1
        out.append(value)
    return out


def write(run: Any, folder: str | Path) -> list[str]:
    """report.html, summary.json and the tables that have rows."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "report.html").write_text(build(run))
    (folder / "summary.json").write_text(json.dumps(run.summary, indent=2, default=str))
    written = ["report.html", "summary.json"]
    for name, df in run.tables().items():
        small = rows_of(df, 100_000) if isinstance(df, list) else None
        if small is not None:
            df = run.spark.createDataFrame([{k: (v if isinstance(v, (int, float, str, bool)) or v is None else str(v)) for k, v in r.items()} for r in small]) if small else None
        if df is not None and df.limit(1).count():
            df.write.mode("overwrite").option("header", True).csv(str(folder / f"{name}.csv"))
            written.append(f"{name}.csv")
    return written
