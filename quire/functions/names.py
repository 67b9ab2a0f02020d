"""Header rules. Column names are schema metadata (bounded by table width),
so they are computed on the driver and applied with one ``toDF``."""

from __future__ import annotations

from collections.abc import Sequence

# The two header rule sets of the reference, each applied
# after stripping outer whitespace, in this order.
CSV_HEADER_REPLACEMENTS = ((",", "_"), ("\n", " "), ('"', "'"))
CSV_EMPTY_HEADER = "empty_col_{i}"
PARQUET_HEADER_REPLACEMENTS = ((" ", "_"), ("\n", "_"))
PARQUET_EMPTY_HEADER = "col_{i}"

RULES = {
    "csv": (CSV_HEADER_REPLACEMENTS, CSV_EMPTY_HEADER),
    "parquet": (PARQUET_HEADER_REPLACEMENTS, PARQUET_EMPTY_HEADER),
}


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "True" if value else "False"
    return str(value)


def clean_names(raw: Sequence[object | None], rules: str = "csv") -> list[str]:
    """Clean a header row. ``None`` cells get a positional name (0-based)."""
    replacements, empty = RULES[rules]
    out = []
    for i, cell in enumerate(raw):
        if cell is None:
            out.append(empty.format(i=i))
            continue
        name = _text(cell).strip()
        for old, new in replacements:
            name = name.replace(old, new)
        out.append(name)
    return out


def duplicates(names: Sequence[str]) -> list[str]:
    """Names that occur more than once, case-insensitively (Spark's resolver)."""
    seen: dict[str, int] = {}
    for n in names:
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
    return sorted({n for n in names if seen[n.lower()] > 1})
