"""Markdown reports of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows a report shows of each table.
LIMITS = {"papers": 50, "claims": 200, "gaps": 20, "records": 100}


def cell(v: object) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, limit: int) -> str:
    """A pipe table of the first rows."""
    rows = df.limit(limit).collect()
    if not rows:
        return "(none)"
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows)])


def gaps(accepted: DataFrame, stats: DataFrame, candidates: int) -> str:
    """Report of accepted gaps (id, type, statement, confidence, reason) over a corpus of given figures."""
    s, rows = stats.first(), accepted.orderBy("id").limit(LIMITS["gaps"]).collect()
    n = accepted.count()
    out = ["# Research gaps", "", f"- Corpus: {s['papers']} papers, {s['with_fulltext']} with full text, {s['with_structured']} structured, {s['resolved']} resolved", f"- Candidates: {candidates}, accepted {n}, rejected {candidates - n}", ""]
    for i, r in enumerate(rows, 1):
        out += [f"## {i}. [{r['type']}] {r['statement']}", f"- confidence: {cell(r['confidence'])}; reason: {cell(r['reason'])}", ""]
    return "\n".join(out if rows else [*out, "No gap was accepted."])


def study(title: str, parts: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{table(df, LIMITS.get(name, 20))}" for name, df in parts.items())])
