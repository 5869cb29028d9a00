"""Small driver-side documents: run state, learned rules, settings, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_json(value: dict, path: str) -> None:
    """Written beside and moved over, so a reader never sees half of it."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_suffix(p.suffix + ".tmp")
    tmp.write_text(json.dumps(value, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(tmp, p)


def load_state(path: str, empty: dict) -> tuple[dict, str]:
    """(state, note): missing or corrupt state starts anew, and says so."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return dict(empty), ""
    except (OSError, ValueError) as e:
        return dict(empty), f"state unreadable ({type(e).__name__}); starting anew"
    return {**empty, **got}, ""


def load_rules(path: str, defaults: dict) -> dict:
    """Rules over their defaults; unreadable rules stop the run, since going on would undo corrections."""
    if not os.path.exists(path):
        return dict(defaults)
    try:
        return {**defaults, **json.loads(Path(path).read_text(encoding="utf-8"))}
    except ValueError as e:
        raise RuntimeError(f"rules at {path} are unreadable") from e


def report(stats: DataFrame, clients: DataFrame, thin: int = 20, most: int = 30) -> str:
    """Markdown from small aggregates: totals, levels, methods (the ``most`` with most samples)."""
    t = clients.agg(
        F.count(F.lit(1)).alias("clients"), F.count(F.when(F.col("client_domain").isNull(), 1)).alias("no_domain"),
        F.count(F.when(F.lower("confidence") == "low", 1)).alias("low"),
    ).first()
    rows = stats.orderBy(F.desc("samples"), "method").limit(most).collect()  # a report's lines, bounded
    out = ["# Report", "", f"- clients: {t['clients']}", f"- without a domain: {t['no_domain']}", f"- low confidence: {t['low']}", "", "| method | good | bad | precision | |", "|-|-|-|-|-|"]
    for r in rows:
        p = "" if r["precision"] is None else f"{r['precision']:.3f}"
        out.append(f"| {r['method']} | {r['good']} | {r['bad']} | {p} | {'few samples' if r['samples'] < thin else ''} |")
    return "\n".join(out) + "\n"
