"""Pages and JSON of results. Data come as rows that a person reads: a funnel's steps, the records of one search."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def embedded(data) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")


def page(title: str, body: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def table(rows: list[dict]) -> str:
    if not rows:
        return "<p>Nothing to show.</p>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
    lines = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{lines}</table>"


def funnel_page(steps: DataFrame, label: str) -> str:
    """Hits of each step and what the next one excludes; steps are as few as concepts."""
    return page(label, table([r.asDict() for r in steps.orderBy("step").collect()]))


def triage_page(records: DataFrame, label: str, most: int = 75) -> str:
    """Records of one search to decide on, as many as a person is asked at once; more raise ValueError."""
    rows = [r.asDict(recursive=True) for r in records.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} records: make the search narrower")
    return page(label, table(rows) + f'<script type="application/json" id="records">{embedded(rows)}</script>')
