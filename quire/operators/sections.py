"""Sections: named column groups carried with key columns.

A section map is metadata (at most one entry per column). Static maps are
given as contiguous ``(section, first, last)`` runs of the column order;
prefix maps come from rules joined to a variables table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.program import apply_rule
from quire.functions.sqltext import ident, lit, literal_frame
from quire.functions.text import py_str
from quire.operators.chunks import head_of_files

SectionMap = Mapping[str, Sequence[str]]


def sections_from_ranges(columns: Sequence[str], ranges: Sequence[tuple[str, str, str]], *,
                         widths: Mapping[str, int] | None = None, disjoint: bool = False) -> dict[str, list[str]]:
    """Expand ``(section, first, last)`` boundaries over a column order.

    A run takes whatever lies between its ends, so a header in another order
    would move columns silently: with ``widths`` (columns per section) a section
    of another width is an error, and with ``disjoint`` a column in two sections.
    """
    pos = {c: i for i, c in enumerate(columns)}
    out: dict[str, list[str]] = {}
    for section, first, last in ranges:
        if first not in pos or last not in pos:
            missing = [c for c in (first, last) if c not in pos]
            raise KeyError(f"section {section}: boundary column(s) not in table: {missing}")
        i, j = pos[first], pos[last]
        if j < i:
            raise ValueError(f"section {section}: {last} comes before {first}")
        out.setdefault(section, []).extend(columns[i:j + 1])
    for section, n in (widths or {}).items():
        if len(out.get(section, ())) != n:
            raise ValueError(f"section {section} has {len(out.get(section, ()))} columns, not {n}: columns were moved, added or dropped")
    if disjoint and (twice := coverage(columns, out)["multi_assigned"]):
        raise ValueError(f"columns in several sections: {twice[:10]}")
    return out


def section_coverage(spark: SparkSession, columns: Sequence[str], ranges: Sequence[tuple[str, str, str]],
                     keys: Sequence[str] = ()) -> DataFrame:
    """What a section map does with a header, one row per column: position (from
    0), name, sections (how many hold it), section (the first of them) and status:
    ``key``, ``ok``, ``uncovered`` or ``doubled``."""
    header = literal_frame(spark, [(i, c) for i, c in enumerate(columns)], "position int, name string")
    runs = literal_frame(spark, [(i, *r) for i, r in enumerate(ranges)], "run int, section string, first string, last string")
    ends = runs.join(header.toDF("a", "first"), "first").join(header.toDF("b", "last"), "last")
    # The columns of each run; a run that ends before it begins has none.
    held = ends.where("a <= b").select("run", "section", F.explode(F.sequence("a", "b")).alias("position"))
    by = held.groupBy("position").agg(F.count("*").cast("int").alias("sections"), F.min_by("section", "run").alias("section"))
    n = F.coalesce("sections", F.lit(0))
    status = (F.when(F.col("name").isin(list(keys)), "key").when(n == 0, "uncovered").when(n == 1, "ok").otherwise("doubled"))
    return header.join(by, "position", "left").select("position", "name", n.alias("sections"), "section", status.alias("status"))


def section_widths(spark: SparkSession, columns: Sequence[str], ranges: Sequence[tuple[str, str, str]],
                   widths: Mapping[str, int]) -> DataFrame:
    """What a header does to a section map, one row per run: section, declared and
    found width, and status: ``ok``, ``missing`` (an end is not in the header),
    ``reversed`` (its last column comes first) or ``moved`` (another width)."""
    header = literal_frame(spark, [(i, c) for i, c in enumerate(columns)], "position int, name string")
    rows = [(i, s, a, b, widths.get(s)) for i, (s, a, b) in enumerate(ranges)]
    runs = literal_frame(spark, rows, "run int, section string, first string, last string, declared int")
    ends = runs.join(header.toDF("a", "first"), "first", "left").join(header.toDF("b", "last"), "last", "left")
    found = F.col("b") - F.col("a") + 1
    status = (F.when(found.isNull(), "missing").when(found < 1, "reversed").when(found != F.col("declared"), "moved").otherwise("ok"))
    return ends.select("run", "section", "declared", found.alias("found"), status.alias("status"))


def coverage(columns: Sequence[str], sections: SectionMap, keys: Sequence[str] = ()) -> dict[str, list]:
    """Columns in no section and columns in more than one."""
    count: dict[str, int] = {}
    for cols in sections.values():
        for c in cols:
            count[c] = count.get(c, 0) + 1
    keyset = set(keys)
    return {
        "unassigned": [c for c in columns if c not in count and c not in keyset],
        "multi_assigned": [c for c in columns if count.get(c, 0) > 1],
        "unknown": sorted(c for c in count if c not in set(columns)),
    }


def project_section(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys first, then the section's columns, in the given order. On a
    Parquet source the scan reads only these columns."""
    return df.select(*[F.col(ident(c)) for c in [*keys, *columns]])


def _head_rows(df: DataFrame, keys: Sequence[str], used: Sequence[str], n: int, file_order: bool) -> DataFrame:
    """The first ``n`` rows, projected to ``used``: by key a top-``n`` (each task
    keeps ``n`` rows, one merge), in file order a read of the first splits only."""
    cols = [F.col(ident(c)) for c in used]
    if file_order:
        return head_of_files(df.select(*cols), n)
    return df.orderBy(*[F.col(ident(k)) for k in keys]).limit(n).select(*cols)


def section_head(df: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 5, *,
                 file_order: bool = False) -> DataFrame:
    """First ``n`` rows of a section by key order, or with ``file_order`` the
    first ``n`` of the file (``df`` is then a file scan)."""
    return _head_rows(df, keys, [*keys, *columns], n, file_order)


def section_heads(df: DataFrame, keys: Sequence[str], sections: SectionMap, n: int = 5,
                  section_col: str = "section", variable_col: str = "variable",
                  value_col: str = "value", *, file_order: bool = False) -> DataFrame:
    """The first ``n`` rows (by key, or of the file) of every section, in one
    long table.

    All sections share their rows, so the head rows are found once and then
    unpivoted; the source is not scanned once per section.
    """
    used = list(dict.fromkeys([*keys, *[c for cols in sections.values() for c in cols]]))
    return sections_long(_head_rows(df, keys, used, n, file_order), keys, sections, section_col, variable_col, value_col)


def split_sections(df: DataFrame, keys: Sequence[str], sections: SectionMap) -> dict[str, DataFrame]:
    """One pruned projection per section over the same source."""
    return {name: project_section(df, keys, cols) for name, cols in sections.items()}


def sections_long(df: DataFrame, keys: Sequence[str], sections: SectionMap,
                  section_col: str = "section", variable_col: str = "variable",
                  value_col: str = "value") -> DataFrame:
    """All sections in one long table: keys, section, variable, value (text).

    One scan and one row-local ``stack`` per input row; a column in several
    sections is emitted once per section. No join, no shuffle.
    """
    used = [c for c in df.columns if c in keys or any(c in cols for cols in sections.values())]
    text = apply_rule(df.select(*[F.col(ident(c)) for c in used]), py_str,
                      [c for c in used if c not in keys])
    triples = []
    for section, cols in sections.items():
        for c in cols:
            triples += [lit(section), lit(c), ident(c)]
    n = len(triples) // 3
    gen = f"stack({n}, {', '.join(triples)}) AS ({ident(section_col)}, {ident(variable_col)}, {ident(value_col)})"
    return text.selectExpr(*[ident(k) for k in keys], gen)


def sections_by_prefix(variables: DataFrame, rules: Sequence[tuple[str, str, str]], *,
                       name_col: str = "name", section_col: str = "section") -> DataFrame:
    """Assign variables to sections by rules ``(section, kind, pattern)``.

    kind ``prefix``: the name starts with pattern (case-sensitive, as
    written); ``name``: the name equals pattern; ``exclude``: the section
    drops names that start with pattern. A name may land in several
    sections; a name in none is not emitted (see ``unmatched_by_prefix``).

    The rules are a short literal list, so each section's test is compiled
    into one boolean expression and the assignment is a row-local
    projection plus ``explode``: no join, no shuffle, any number of names.
    Output: the variables' columns plus ``section``.
    """
    return variables.withColumn(section_col, F.explode(_section_array(rules, name_col)))


def unmatched_by_prefix(variables: DataFrame, rules: Sequence[tuple[str, str, str]], *,
                        name_col: str = "name") -> DataFrame:
    """Variables that no rule assigns to any section."""
    return variables.where(F.size(_section_array(rules, name_col)) == 0)


def _section_array(rules: Sequence[tuple[str, str, str]], name_col: str) -> F.Column:
    by_section: dict[str, dict[str, list[str]]] = {}
    for section, kind, pattern in rules:
        if kind not in ("prefix", "name", "exclude"):
            raise ValueError(f"unknown rule kind {kind!r}")
        by_section.setdefault(section, {}).setdefault(kind, []).append(pattern)
    name = F.col(ident(name_col))
    tests = []
    for section, kinds in by_section.items():
        member = F.lit(False)
        for p in kinds.get("prefix", []):
            member = member | name.startswith(p)
        if kinds.get("name"):
            member = member | name.isin(*kinds["name"])
        for p in kinds.get("exclude", []):
            member = member & ~name.startswith(p)
        tests.append(F.when(member, F.lit(section)))
    if not tests:
        return F.array().cast("array<string>")
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def prefix_rules(groups: Mapping[str, Mapping[str, Sequence[str]]]) -> list[tuple[str, str, str]]:
    """Flatten ``{section: {"prefix": [...], "name": [...], "exclude": [...]}}``."""
    out = []
    for section, kinds in groups.items():
        for kind, patterns in kinds.items():
            out += [(section, kind, p) for p in patterns]
    return out
