"""HTML reports of small result tables. A report holds aggregates; a table above its row bound is refused, not cut."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.lineage import settled

ROWS = 5000
STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}"


def table_html(rows: DataFrame, most: int = ROWS) -> str:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report's table has at most {most} rows: aggregate it first")
    cell = lambda x: html.escape("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in found) + "</table>"


def curve_svg(rows: DataFrame, x: str, y: str, width: int = 720, height: int = 240, most: int = ROWS) -> str:
    """A line of y over x, drawn from an aggregate that is small enough."""
    points = [r[y] for r in rows.select(x, y).orderBy(x).limit(most + 1).collect() if r[y] is not None]
    if len(points) > most:
        raise ValueError(f"a curve has at most {most} points: aggregate it first")
    if len(points) < 2:
        return "<p>no curve</p>"
    low, high = min(points), max(points)
    scale = (high - low) or 1.0
    path = " ".join(f"{k * width / (len(points) - 1):.1f},{height - (p - low) / scale * height:.1f}" for k, p in enumerate(points))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="#246" points="{path}"/></svg>'


def report(title: str, sections: dict[str, str], facts: dict | None = None) -> str:
    body = "".join(f"<h2>{html.escape(k)}</h2>{v}" for k, v in sections.items())
    told = f"<pre>{html.escape(json.dumps(facts, sort_keys=True, indent=1))}</pre>" if facts else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{told}{body}</body></html>"


def experiment(title: str, metrics: DataFrame, curves: DataFrame, facts: dict | None = None, most: int = ROWS) -> str:
    """The report of an experiment: a row of metrics for each fold and scenario, and for each scenario its curve and its fall from the
    highest point so far. curves: scenario, week, equity, few enough points; more than the bound are refused. They are computed once."""
    falls = settled(curves.withColumn("fall", F.col("equity") / F.max("equity").over(Window.partitionBy("scenario").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)) - 1))
    sections = {"Folds": table_html(metrics.orderBy(*metrics.columns[:2]), most)}
    totals = falls.groupBy("scenario").agg(F.count("*").alias("n_points"), F.min_by("equity", "week").alias("first"), F.max_by("equity", "week").alias("last"), F.min("fall").alias("deepest_fall")).orderBy("scenario")
    sections["Curves"] = table_html(totals, most)
    for r in totals.collect():
        sections[f"Curve of {r.scenario}"] = curve_svg(falls.filter(F.col("scenario") == r.scenario), "week", "equity", most=most)
    return report(title, sections, facts)
