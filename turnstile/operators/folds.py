"""Keyed running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Measures are (aggregate, SQL expression) by name; each of these aggregates merges its own partial results.
Measures = dict[str, tuple[str, str]]


def aggregates(measures: Measures) -> str:
    return ", ".join(f"{how}({value}) as {name}" for name, (how, value) in measures.items())


def merged(measures: Measures) -> str:
    return ", ".join(f"{how}({name}) as {name}" for name, (how, _) in measures.items())


def fold(entries: DataFrame, by: str, measures: Measures, label_order: str | None = None) -> DataFrame:
    """Fold `entries` by the columns `by`. With `label_order`, also keep the (id, name) that came first by it.

    `label_order` names one of the measures (a min of the arrival number, NULL where a row may not name the group).

    In batch, (id, name) joins the grouping key of a first hash aggregate and the few surviving rows are folded
    again: every pass over raw rows combines map-side, so a hot key costs one row per task. A streaming query may
    hold only one aggregate, so there the label is a `min_by` in it.
    """
    run = entries.sparkSession.sql
    if label_order is None:
        return run(f"select {by}, {aggregates(measures)} from {{entries}} group by {by}", entries=entries)
    if entries.isStreaming:
        out = run(f"""select {by}, {aggregates(measures)}, min_by(struct(id, name), {measures[label_order][1]}) as label
                      from {{entries}} group by {by}""", entries=entries)
    else:
        out = run(f"""select {by}, {merged(measures)}, min_by(struct(id, name), {label_order}) as label
                      from (select {by}, id, name, {aggregates(measures)} from {{entries}} group by {by}, id, name)
                      group by {by}""", entries=entries)
    return out.selectExpr(by, *measures, "label.id as id", "label.name as name")
