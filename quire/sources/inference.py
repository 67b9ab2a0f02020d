"""Types of text columns, from all their values in one aggregate.

Every value has the set of types it can be read as, as bits; the types of a
column are what all its values have in common (``bit_and``, which merges over
splits in any order), and the first of ORDER among them is taken. A column
without a value, or whose values have no type in common, is text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.functions.sqltext import alias, ident, lit
from quire.functions.text import NUMBER_TEXT

#: From the narrowest to the widest; the bit of a type is its place.
ORDER = (T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType())
INT, LONG, WHOLE, REAL, BOOL, DATE, TIME = (1 << i for i in range(len(ORDER)))

WHOLE_TEXT = "^[+-]?[0-9]{1,38}$"
DATE_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def type_bits(c: str) -> str:
    """SQL text of the types that the text ``c`` can be read as; null for a null."""
    return (f"CASE WHEN {c} IS NULL THEN NULL "
            f"WHEN {c} RLIKE {lit(WHOLE_TEXT)} THEN "
            f"CASE WHEN try_cast({c} AS INT) IS NOT NULL THEN {INT | LONG | WHOLE | REAL} "
            f"WHEN try_cast({c} AS BIGINT) IS NOT NULL THEN {LONG | WHOLE | REAL} ELSE {WHOLE | REAL} END "
            f"WHEN {c} RLIKE {lit(NUMBER_TEXT)} THEN {REAL} "
            f"WHEN lower({c}) IN ('true', 'false') THEN {BOOL} "
            f"WHEN {c} RLIKE {lit(DATE_TEXT)} THEN IF(try_cast({c} AS DATE) IS NULL, 0, {DATE | TIME}) "
            f"WHEN {c} RLIKE {lit(TIME_TEXT)} THEN IF(try_cast({c} AS TIMESTAMP) IS NULL, 0, {TIME}) ELSE 0 END")


def infer_types(df: DataFrame, sampling_ratio: float | None = None) -> T.StructType:
    """The narrowest types that hold all values of the text columns of ``df``
    (or of a fraction of its rows)."""
    names = df.columns
    work = df.toDF(*(f"c{i}" for i in range(len(names))))
    if sampling_ratio is not None:
        work = work.sample(sampling_ratio, seed=0)
    got = work.selectExpr(*(alias(f"bit_and({type_bits(ident(c))})", c) for c in work.columns)).head() if names else []
    fields = []
    for name, bits in zip(names, got):
        fits = [t for i, t in enumerate(ORDER) if bits and bits >> i & 1]
        fields.append(T.StructField(name, fits[0] if fits else T.StringType()))
    return T.StructType(fields)
