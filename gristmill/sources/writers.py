"""Sinks for chunks, vectors, results, metrics and the HTML report. Writing again replaces what was there."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import score_class
from gristmill.operators import reporting
from gristmill.operators.vector import embed


def write_chunks(chunks: DataFrame, folder: str, form: str = "parquet") -> None:
    """One partition folder per framework, so that a search over some frameworks reads only theirs; rows are clustered by framework, not gathered by it."""
    chunks.write.mode("overwrite").partitionBy("framework_name").format(form).save(folder)


def write_vectors(chunks: DataFrame, folder: str, encode: Callable | None = None, text: str = "text") -> None:
    """Chunks with their embedding column; ``encode``, called on batches of texts, makes it where it is not there."""
    if "embedding" not in chunks.columns:
        if encode is None:
            raise ValueError("no embedding column and nothing to make it with")
        chunks = embed(chunks, text, encode=encode)
    chunks.filter(F.col("embedding").isNotNull()).write.mode("overwrite").partitionBy("framework_name").parquet(folder)


def write_results(results: DataFrame, folder: str) -> None:
    """Detailed results as JSON, a folder per model; scored and unscored results belong in different folders."""
    results.write.mode("overwrite").partitionBy("model_name").json(folder)


def write_models(models: DataFrame, folder: str, now: str) -> None:
    models.withColumn("cached_at", F.lit(now).cast("timestamp")).write.mode("overwrite").json(folder)


def metrics_document(results: DataFrame) -> dict:
    """Overall and per-model aggregates as plain values; as many rows as there are models and modes."""
    overall = reporting.score_metrics(results, [], "accuracy_score", "scoring_error").first().asDict()
    models = [r.asDict() for r in reporting.score_metrics(results, ["model_name"], "accuracy_score").orderBy(F.desc("mean_score"), "model_name").collect()]
    modes = {r["mode"]: r["mean_score"] for r in reporting.run_summary(results, "model_name", "evaluation_mode", "accuracy_score").filter("level = 'mode'").orderBy("mode").collect()}
    quality = {r.model_name: {b: r[b] for b in ("high", "medium", "low")} for r in reporting.quality_distribution(results, ["model_name"], "accuracy_score").collect()}
    return {"overall": overall, "modes": modes, "models": [m | quality.get(m["model_name"], {}) for m in models]}


def save_json(value, path: str) -> None:
    """A plain value as a JSON file on the driver; folders on the way are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str), encoding="utf-8")


def write_metrics(results: DataFrame, path: str) -> dict:
    found = metrics_document(results)
    save_json(found, path)
    return found


def write_comparison(current: DataFrame, previous: DataFrame, path: str) -> list[dict]:
    rows = [r.asDict() for r in reporting.compare_runs(current, previous, "model_name", "accuracy_score").orderBy("model_name").collect()]
    save_json(rows, path)
    return rows


def model_details(results: DataFrame) -> dict[str, list[dict]]:
    """Of each model, a row for every mode: responses, scored, mean, deviation, least and largest; as many rows as there are models and modes."""
    rows = reporting.score_metrics(results, ["model_name", "evaluation_mode"], "accuracy_score").orderBy("model_name", "evaluation_mode").collect()
    found: dict[str, list[dict]] = {}
    for r in rows:
        found.setdefault(r.model_name, []).append(r.asDict())
    return found


def write_report(results: DataFrame, path: str, title: str = "Evaluation") -> None:
    """A page with the overall figures, the modes, a table of models by falling mean score and the modes of each model."""
    found, details = metrics_document(results), model_details(results)
    classes = {r.model_name: r["class"] for r in results.groupBy("model_name").agg(score_class(reporting.or_zero(F.avg("accuracy_score"))).alias("class")).collect()}
    text = lambda x: html.escape(str(x))
    number = lambda x: f"{x:.3f}"
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    o = found["overall"]
    rows = "".join(f"<tr class='{classes[m['model_name']]}'><td>{text(m['model_name'])}</td><td>{m['total']}</td><td>{m['scored']}</td><td>{number(m['mean_score'])}</td><td>{number(m['std_score'])}</td><td>{m.get('high', 0)} / {m.get('medium', 0)} / {m.get('low', 0)}</td></tr>" for m in found["models"])
    modes = "".join(f"<li>{text(k)}: {number(v)}</li>" for k, v in found["modes"].items())
    sections = []
    for m in found["models"]:
        lines = "".join(row(text(d["evaluation_mode"]), d["total"], d["scored"], number(d["mean_score"]), number(d["std_score"]), number(d["min_score"]), number(d["max_score"])) for d in details.get(m["model_name"], []))
        sections.append(f"<h3 class='{classes[m['model_name']]}'>{text(m['model_name'])}</h3><table><tr><th>mode</th><th>responses</th><th>scored</th><th>mean</th><th>deviation</th><th>least</th><th>largest</th></tr>{lines}</table>")
    page = f"""<!doctype html><html><head><meta charset="utf-8"><title>{text(title)}</title><style>.high td{{background:#dfd}}.low td{{background:#fdd}}td,th{{padding:2px 8px}}</style></head><body><h1>{text(title)}</h1>
<p>{o['total']} responses, {o['scored']} scored, mean {number(o['mean_score'])}, success {o['success_rate']:.1f} percent</p><h2>Modes</h2><ul>{modes}</ul><h2>Models</h2>
<table><tr><th>model</th><th>responses</th><th>scored</th><th>mean</th><th>deviation</th><th>high / medium / low</th></tr>{rows}</table><h2>Modes of each model</h2>{''.join(sections)}</body></html>"""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page, encoding="utf-8")


def console_summary(results: DataFrame) -> str:
    """Overall figures, modes and models as lines of text; modes of a model whose mean is 0 are left out."""
    found, details = metrics_document(results), model_details(results)
    out = ["Results", f"  responses: {found['overall']['total']}", f"  mean score: {found['overall']['mean_score']:.3f}", "By mode"]
    out += [f"  {str(k).replace('_', ' ')}: {v:.3f}" for k, v in found["modes"].items()]
    out.append("By model")
    for m in found["models"]:
        out.append(f"  {m['model_name']}: {m['mean_score']:.3f}")
        out += [f"    {str(d['evaluation_mode']).replace('_', ' ')}: {d['mean_score']:.3f}" for d in details.get(m["model_name"], []) if d["mean_score"] > 0]
    return "\n".join(out)


def write_all_reports(results: DataFrame, folder: str, previous: DataFrame | None = None, title: str = "Evaluation") -> dict[str, str]:
    """metrics.json, report.html and, with a previous run, comparison.json in one folder; returns their paths."""
    paths = {"metrics": f"{folder}/metrics.json", "report": f"{folder}/report.html"}
    write_metrics(results, paths["metrics"])
    write_report(results, paths["report"], title)
    if previous is not None:
        paths["comparison"] = f"{folder}/comparison.json"
        write_comparison(results, previous, paths["comparison"])
    return paths
