"""Result tables of an analysis: what was found, done and trained, a row a fact, and reports as text."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame, SparkSession

from lumen.plans.cleaning import Result
from lumen.plans.insights import Insight, serialise
from lumen.plans.ml import Outcome
from lumen.plans.profile import Profile
from lumen.sources.sinks import Catalog

PROFILE = "column string, type string, kind string, rows long, nulls long, missing double, distinct long"
INSIGHT = "rank int, kind string, feature string, finding string, confidence double, confidence_label string, severity string, p double, effect double, n long, facts string"
ACTION = "detector string, problem string, column string, verdict string, action string, count long, ratio double, reason string"
MODEL = "status string, model string, task string, seconds double, left_out string, warnings string"


def profile_rows(spark: SparkSession, ps: dict[str, Profile]) -> DataFrame:
    return spark.createDataFrame([(p.name, p.type, p.kind, p.rows, p.nulls, float(p.missing), p.unique) for p in ps.values()], PROFILE)


def insight_rows(spark: SparkSession, found: list[Insight]) -> DataFrame:
    """Insights in their order."""
    rows = []
    for i, x in enumerate(found, 1):
        s = serialise(x)
        rows.append((i, s["kind"], s["feature"], s["finding"], float(s["confidence"]), s["confidence_label"], s["severity"], None if s["p"] is None else float(s["p"]), float(s["effect"]), int(s["n"]), json.dumps(s["facts"], sort_keys=True, default=str)))
    return spark.createDataFrame(rows, INSIGHT)


def action_rows(spark: SparkSession, results: list[Result]) -> DataFrame:
    """Decisions of cleaning runs; one of several with the same problem, column and verdict."""
    seen = {}
    for d in [d for r in results for d in r.decisions]:
        e = d.evidence
        seen.setdefault((e.problem, e.column, d.verdict), (e.detector, e.problem, e.column, d.verdict, d.action, int(e.count), float(e.ratio), d.reason))
    return spark.createDataFrame(list(seen.values()), ACTION)


def model_rows(spark: SparkSession, o: Outcome) -> dict[str, DataFrame]:
    """A model's outcome as tables: itself, its metrics, and the weights of its features."""
    return {
        "model": spark.createDataFrame([(o.status, o.model, o.task, float(o.seconds), json.dumps(o.left_out, sort_keys=True), json.dumps(o.warnings))], MODEL),
        "metrics": spark.createDataFrame([(k, float(v)) for k, v in o.metrics.items() if v is not None], "metric string, value double"),
        "importance": spark.createDataFrame([(i, f, float(w)) for i, (f, w) in enumerate(o.importance, 1)], "rank int, feature string, weight double"),
    }


def save_analysis(catalog: Catalog, analysis: str, ps: dict[str, Profile], frames: dict[str, DataFrame] | None = None, found: list[Insight] | None = None, cleaned: list[Result] | None = None, model: Outcome | None = None) -> list[str]:
    """Writes all that is given as tables of one analysis and marks it completed; a failure is marked too. Returns the tables' names."""
    spark = catalog.spark
    tables = {"profiles": profile_rows(spark, ps), **(frames or {})}
    if found is not None:
        tables["insights"] = insight_rows(spark, found)
    if cleaned is not None:
        tables["actions"] = action_rows(spark, cleaned)
    if model is not None:
        tables |= model_rows(spark, model)
    catalog.create(analysis)
    try:
        for name, df in tables.items():
            catalog.save(analysis, name, df)
    except Exception as e:
        catalog.fail(analysis, str(e)[:500])
        raise
    catalog.complete(analysis, tables=sorted(tables))
    return sorted(tables)


def as_markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a frame as a table."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect()]) + "\n"


def statistics_section(numeric: DataFrame | None, correlations: DataFrame | None, outlier: DataFrame | None) -> str:
    parts = [("Numbers", numeric, ["column", "count", "mean", "median", "std", "min", "max"]), ("Correlations", correlations, ["a", "b", "r", "n", "strength"]), ("Outliers", outlier, ["column", "outliers", "percentage", "severity"])]
    return "\n".join(f"### {title}\n\n{as_markdown(df.select(*[c for c in cols if c in df.columns]))}" for title, df, cols in parts if df is not None)


def insights_section(found: list[Insight]) -> str:
    return "\n".join(f"{i}. **{x.kind.replace('_', ' ')}**, {serialise(x)['severity']}: {x.finding} (confidence {x.confidence:.2f}{f', p = {x.p:.3g}' if x.p is not None else ''})" for i, x in enumerate(found, 1)) + "\n"


def model_section(o: Outcome) -> str:
    if o.status != "trained":
        return f"No model: {'; '.join(o.warnings) or o.status}.\n"
    lines = [f"{o.model} ({o.task}), {o.seconds:.1f} s.", "", "| metric | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in o.metrics.items()]]
    lines += ["", "| feature | weight |", "|-|-|", *[f"| {f} | {w:.4g} |" for f, w in o.importance]] if o.importance else []
    return "\n".join(lines) + "\n"


def cleaning_section(r: Result) -> str:
    lines = [f"{r.assessment}: {r.before['rows']} rows before, {r.after['rows']} after.", ""]
    lines += [f"- {d.action} on {d.evidence.column or 'the table'}: {d.evidence.count} cells or rows ({d.reason})" for d in r.decisions if d.verdict == "apply"]
    lines += [f"- left as it is: {d.evidence.problem} of {d.evidence.column or 'the table'} ({d.evidence.count})" for d in r.decisions if d.verdict != "apply"]
    return "\n".join(lines + [f"- warning: {w}" for w in r.warnings]) + "\n"


def as_html(markdown: str, title: str = "Report") -> str:
    """A page of headings, lists, tables and paragraphs."""
    out, table, items = [], [], []

    def inline(s: str) -> str:
        return re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", html.escape(s, quote=False))

    def flush() -> None:
        if table:
            head, *body = table
            cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{inline(c.strip())}</{tag}>" for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))) + "</tr>"
            out.append("<table>" + cells(head, "th") + "".join(cells(r, "td") for r in body if not re.fullmatch(r"[|\s:-]+", r)) + "</table>")
            table.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{inline(x)}</li>" for x in items) + "</ul>")
            items.clear()

    for line in markdown.splitlines():
        if line.startswith("|"):
            table.append(line)
        elif m := re.match(r"(?:[-*]|\d+\.)\s+(.*)", line):
            items.append(m[1])
        else:
            flush()
            if m := re.match(r"(#+)\s+(.*)", line):
                out.append(f"<h{min(6, len(m[1]))}>{inline(m[2])}</h{min(6, len(m[1]))}>")
            elif line.strip():
                out.append(f"<p>{inline(line)}</p>")
    flush()
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(out)}</body></html>"


def save_report(spark: SparkSession, path: str, markdown: str, title: str = "Report") -> None:
    """The report as ``markdown`` and ``html`` text below path."""
    for kind, text in (("markdown", markdown), ("html", as_html(markdown, title))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{kind}")
