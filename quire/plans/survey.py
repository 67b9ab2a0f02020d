"""The survey layout of the reference, as data.

Section boundaries are stored as contiguous runs of the table's column
order, not as the 3,799 names they expand to.
"""

from __future__ import annotations

from collections.abc import Sequence

from quire.operators.sections import prefix_rules, sections_from_ranges

# Key columns carried by every section projection.
SURVEY_KEYS = ["interview__key", "interview__id"]

# The 33 static sections as (section, first column, last column),
# in the order of the survey's column list.
SECTION_RANGES = [
    ("A", "county", "A24vi"),
    ("B1", "B1A", "CountFINANCIAL_HEALTH"),
    ("B2", "B2A", "secFinancial_Awareness"),
    ("B3", "B3A__1", "CountLivelihood"),
    ("C1", "C1_10", "C4i"),
    ("D1", "D1A__1", "D1Mf"),
    ("D", "D1", "D13_7"),
    ("E", "E1", "E5_Others_Specify"),
    ("E1", "E1iA", "E1_iii_Other"),
    ("E2", "E2A", "E2H__99"),
    ("E3", "E3A__1", "E3D__99"),
    ("F", "F1__1", "F3_Other"),
    ("F1", "F1iA", "F1_1Other"),
    ("F2", "F2Ai", "F2Mf"),
    ("G", "G1A1__1", "G12_Other"),
    ("H", "H1", "H16_6"),
    ("I", "I1a__0", "IsSectionAnsweredSecI"),
    ("J", "J1__1", "CountSecJ"),
    ("K1", "K1", "K14_6"),
    ("L", "L1_1", "L3ii_5"),
    ("M", "M1", "M12_6"),
    ("N", "N1", "N14"),
    ("O", "O1", "CountO"),
    ("P", "P1i", "CountP"),
    ("Q", "Q1", "CountQ"),
    ("R1", "R1Cia", "CountR1"),
    ("R2", "R2A__1", "CountR2"),
    ("R3", "R3A", "CountR3"),
    ("S", "S1", "CountS"),
    ("T", "T1", "IsSectionAnsweredSeCT"),
    ("U", "U1", "IsSectionAnsweredU"),
    ("V", "Latitude", "Longitude"),
    ("Other", "EndofInt_Time", "PWD"),
]

# Columns in each static section.
SECTION_WIDTHS = {
    "A": 40, "B1": 43, "B2": 12, "B3": 188, "C1": 111, "D1": 55, "D": 62, "E": 66, "E1": 281, "E2": 61, "E3": 28,
    "F": 30, "F1": 74, "F2": 74, "G": 569, "H": 290, "I": 125, "J": 257, "K1": 70, "L": 26, "M": 80, "N": 95,
    "O": 50, "P": 187, "Q": 304, "R1": 11, "R2": 44, "R3": 31, "S": 22, "T": 8, "U": 125, "V": 2, "Other": 378,
}

# The 17 prefix groups (prefixes are tuples: any one matches;
# "name" entries are members by exact name; "exclude" removes a prefix).
PREFIX_GROUPS = {
    "A": {"prefix": ["A0", "A1", "A2", "A9"],
          "name": ["county", "Z1", "RESPONDENT", "Sex", "Age", "NHM", "FHH_Spouse"]},
    "B": {"prefix": ["B1", "B2", "B3"]},
    "C": {"prefix": ["C1", "C2", "C3", "C4"]},
    "D1": {"prefix": ["D1", "D5", "D6"]},
    "D": {"prefix": ["D"], "exclude": ["D1"]},
    "E": {"prefix": ["E1", "E2", "E3", "E4", "E5"]},
    "F": {"prefix": ["F1", "F2", "F3"]},
    "GH": {"prefix": ["G", "H"]},
    "I": {"prefix": ["I"]},
    "J": {"prefix": ["J"]},
    "KM": {"prefix": ["K", "M"]},
    "L": {"prefix": ["L"]},
    "N": {"prefix": ["N"]},
    "OPQ": {"prefix": ["O", "P", "Q"]},
    "R": {"prefix": ["R"]},
    "ST": {"prefix": ["S", "T"]},
    "U": {"prefix": ["U"]},
}


def survey_sections(columns: Sequence[str]) -> dict[str, list[str]]:
    """The static section map expanded over a survey table's columns; a header in
    which a section has another width, or shares a column, is an error."""
    return sections_from_ranges(columns, SECTION_RANGES, widths=SECTION_WIDTHS, disjoint=True)


def survey_prefix_rules() -> list[tuple[str, str, str]]:
    return prefix_rules(PREFIX_GROUPS)
