"""Scores answers against ground truth: cells must be among the true ones, single values must be the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

CELLS, EXACT = "cells", "exact"


@dataclass(frozen=True)
class Question:
    """tools: those that may answer it, the preferred one first; compare: CELLS or EXACT; rows: axes that it may be grouped by."""

    name: str
    tools: tuple[str, ...]
    compare: str = EXACT
    rows: tuple[str, ...] | None = None
    series: str | None = None


@dataclass(frozen=True)
class Step:
    tool: str
    done: bool
    result: DataFrame | None = None
    rows: str | None = None
    series: str | None = None
    error: str | None = None


@dataclass(frozen=True)
class Score:
    name: str
    tool: bool
    axes: bool | None
    data: bool
    emitted: int | None
    available: int | None
    note: str


def comparable(df: DataFrame) -> DataFrame:
    """Rows as trimmed text, by place of the column."""
    from pyspark.sql import functions as F

    return df.select([F.trim(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(df.columns)])


def score(question: Question, steps: list[Step], truth: DataFrame) -> Score:
    """The last finished step of a tool that may answer the question is the answer.

    A chart shows the largest cells only, so cells are right if all of them are true ones, and how
    many of those there are is told; anything else must agree exactly."""
    step = next((s for s in reversed(steps) if s.done and s.tool in question.tools), None)
    if step is None:
        refused = next((s for s in steps if s.tool == question.tools[0]), None)
        called = ", ".join(s.tool for s in steps) or "no tool"
        return Score(question.name, False, None, False, None, None, f"refused: {refused.error}" if refused else f"called {called}")
    axes = None if question.rows is None else step.rows in question.rows and (question.series is None or step.series == question.series)
    got, want = comparable(step.result), comparable(truth)
    if len(got.columns) != len(want.columns):
        return Score(question.name, True, axes, False, None, None, "other columns")
    wrong = got.exceptAll(want).count()
    emitted, available = got.count(), want.count()
    if question.compare == CELLS:
        note = "no cells" if not emitted else f"{wrong} of {emitted} cells are not true" if wrong else f"{emitted} of {available} true cells"
        return Score(question.name, True, axes, emitted > 0 and not wrong, emitted, available, note)
    exact = not wrong and emitted == available
    return Score(question.name, True, axes, exact, None, None, "exact" if exact else f"{wrong} of {emitted} rows differ, {available} wanted")
