"""Staged column programs.

A cell rule that needs an intermediate value several times (the text of a
double, say) would otherwise copy that sub-expression into every use, and
rules applied on top of rules multiply the copies. A program names each
intermediate as a temporary column of an earlier projection instead; the
optimizer keeps such projections apart when a non-trivial value is used
more than once, so every expression stays small however wide the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.functions.sqltext import ident


class Ref(str):
    """SQL text of a column reference, with the stage that produces it."""

    level: int

    def __new__(cls, text: str, level: int) -> "Ref":
        obj = super().__new__(cls, text)
        obj.level = level
        return obj


class Program:
    def __init__(self, prefix: str) -> None:
        self.prefix = prefix
        self.defs: list[tuple[str, str, int]] = []

    def let(self, expr: str, *deps: str) -> Ref:
        level = 1 + max((getattr(d, "level", 0) for d in deps), default=0)
        name = f"{self.prefix}_{len(self.defs)}"
        self.defs.append((name, expr, level))
        return Ref(ident(name), level)


Rule = Callable[[Program, Ref, T.DataType], str]


def apply_rule(df: DataFrame, rule: Rule, columns: Sequence[str] | None = None) -> DataFrame:
    """Apply ``rule`` to every (or the chosen) column; others pass through.

    One projection when no rule names an intermediate; otherwise one extra
    projection per level of intermediates. Duplicate column names (kept by
    the CSV header rules) are handled by working on positional names.
    Rows stay in their order and partitions.
    """
    chosen = set(df.columns if columns is None else columns)
    names = list(df.columns)
    positional = len({n.lower() for n in names}) != len(names)
    work_names = [f"_q{i}" for i in range(len(names))] if positional else names
    work = df
    if positional:
        work = work.toDF(*work_names)
    finals: list[str] = []
    defs: list[tuple[str, str, int]] = []
    for i, (w, f) in enumerate(zip(work_names, df.schema.fields)):
        if f.name in chosen:
            prog = Program(f"_q{i}t")
            finals.append(f"{rule(prog, Ref(ident(w), 0), f.dataType)} AS {ident(w)}")
            defs += prog.defs
        else:
            finals.append(ident(w))
    for level in sorted({d[2] for d in defs}):
        new = [f"{expr} AS {ident(name)}" for name, expr, lv in defs if lv == level]
        work = work.selectExpr("*", *new)
    out = work.selectExpr(*finals)
    return out.toDF(*names) if positional else out
