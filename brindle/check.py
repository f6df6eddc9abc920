"""Compare a result with an expected one: every column, ties in any order, numbers within a tolerance.

Golden results are CSV files ``<report>_<scale>.csv`` of a folder, as saved here
or by another engine.
"""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSOLUTE, RELATIVE = 1e-2, 1e-4


def _number(x) -> bool:
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def same(a, b, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> bool:
    if a is None or b is None:
        return a is b
    if _number(a) and _number(b):
        return math.isclose(float(a), float(b), rel_tol=relative, abs_tol=absolute) or float(a) != float(a) and float(b) != float(b)
    return a == b


def differences(columns: Sequence[str], rows: Iterable[Sequence], want_columns: Sequence[str], want: Iterable[Sequence], absolute: float = ABSOLUTE, relative: float = RELATIVE) -> list[str]:
    """What differs; empty if nothing does.  Missing columns are a difference."""
    if sorted(columns) != sorted(want_columns):
        return [f"columns {sorted(columns)} for {sorted(want_columns)}"]
    order = [list(columns).index(c) for c in want_columns]
    have, need = [tuple(r[i] for i in order) for r in rows], [tuple(r) for r in want]
    if len(have) != len(need):
        return [f"{len(have)} rows for {len(need)}"]

    def key(r):
        return tuple(f"{float(x):.6g}" if _number(x) else repr(x) for x in r)

    return [f"{a} for {b}" for a, b in zip(sorted(have, key=key), sorted(need, key=key), strict=True) if not all(same(x, y, absolute, relative) for x, y in zip(a, b, strict=True))]


def write_csv(df: DataFrame, path: str) -> None:
    """A result of any size as a folder of CSV files with headers; an empty string is quoted, a null is not."""
    df.write.csv(path, header=True, quote='"', escape='"', nullValue=None, emptyValue='""')


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', mode="FAILFAST")


#: Headers that engines give a column without a name.
HEADERS = {"sum(l_quantity)": "sum_quantity"}


def golden_name(name: str, scale: str) -> str:
    """q06 of scale SF1 is Q6_SF1.csv."""
    return f"{name[0].upper()}{int(name[1:])}_{scale}.csv" if name[0] == "q" else f"{name.upper()}_{scale}.csv"


def read_golden(spark: SparkSession, path: str, schema: T.StructType) -> tuple[list[str], list[tuple]]:
    """Columns and rows of an expected result, its values read in the types of the result."""
    kinds = {f.name: f.dataType for f in schema}
    lines = io.StringIO("\n".join(r["value"] for r in spark.read.text(path).collect()))
    rows = csv.reader(lines)
    columns = [HEADERS.get(c, c) for c in next(rows)]

    def value(c: str, x: str):
        kind = kinds.get(c)
        if isinstance(kind, T.NumericType):
            return None if x == "" else int(x) if isinstance(kind, T.IntegralType) else float(x)
        return x

    return columns, [tuple(value(c, x) for c, x in zip(columns, r, strict=True)) for r in rows if r]


def check_golden(df: DataFrame, path: str, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> list[str]:
    """What differs between a report's result and its golden file."""
    columns, want = read_golden(df.sparkSession, path, df.schema)
    plain = df.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(f.name) for f in df.schema))
    have = [tuple("" if x is None and not isinstance(f.dataType, T.NumericType) else x for x, f in zip(r, df.schema, strict=True)) for r in plain.toLocalIterator()]
    return differences(plain.columns, have, columns, want, absolute, relative)


def to_csv(df: DataFrame) -> str:
    """A small result as CSV with four decimals, quoted where needed."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for r in df.toLocalIterator():
        w.writerow([f"{x:.4f}" if isinstance(x, (float, Decimal)) else "" if x is None else x for x in r])
    return out.getvalue()
