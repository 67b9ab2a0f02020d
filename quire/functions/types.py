"""Declared-type dictionary: Stata storage codes -> SQL types -> Spark types."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.sqltext import lit

# Stata storage type -> PostgreSQL type, as declared by the
# reference (33 entries). Codes outside this table map to the text "None".
STATA_TO_SQL = {
    "byte": "SMALLINT",
    "int": "INTEGER",
    "long": "BIGINT",
    "float": "REAL",
    "double": "DOUBLE PRECISION",
    "str1": "VARCHAR(1)",
    "str4": "VARCHAR(4)",
    "str6": "VARCHAR(6)",
    "str7": "VARCHAR(7)",
    "str8": "VARCHAR(8)",
    "str11": "VARCHAR(11)",
    "str12": "VARCHAR(12)",
    "str13": "VARCHAR(13)",
    "str14": "VARCHAR(14)",
    "str15": "VARCHAR(15)",
    "str16": "VARCHAR(16)",
    "str17": "VARCHAR(17)",
    "str18": "VARCHAR(18)",
    "str19": "VARCHAR(19)",
    "str20": "VARCHAR(20)",
    "str21": "VARCHAR(21)",
    "str22": "VARCHAR(22)",
    "str24": "VARCHAR(24)",
    "str25": "VARCHAR(25)",
    "str26": "VARCHAR(26)",
    "str27": "VARCHAR(27)",
    "str28": "VARCHAR(28)",
    "str29": "VARCHAR(29)",
    "str30": "VARCHAR(30)",
    "str32": "VARCHAR(32)",
    "str99": "VARCHAR(99)",
    "strL": "TEXT",
    "strl": "TEXT",
}
UNMAPPED = "None"

# SQL type names -> Spark types used when loading with declared types.
_SQL_TO_SPARK = {
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "REAL": T.FloatType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "TEXT": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
_VARCHAR = re.compile(r"^(?:VARCHAR|CHARACTER VARYING|CHAR)\s*\(\s*\d+\s*\)$")


def sql_to_spark(sql_type: str) -> T.DataType:
    """Spark type for a declared SQL type; VARCHAR(n) is carried as string."""
    key = " ".join(sql_type.strip().upper().split())
    if _VARCHAR.match(key):
        return T.StringType()
    if key in _SQL_TO_SPARK:
        return _SQL_TO_SPARK[key]
    raise ValueError(f"no Spark type for declared SQL type {sql_type!r}")


def type_map_column() -> F.Column:
    """The dictionary as a literal map column (33 entries, evaluated in the JVM)."""
    items = []
    for k, v in STATA_TO_SQL.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)
