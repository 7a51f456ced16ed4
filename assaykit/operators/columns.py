"""Column choice, row filters and alignment joins (projection part of the workflow)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.table import c, numeric_columns

# Accepted spellings of coordinate columns.
LONGITUDE_NAMES = ("LONGITUDE", "Longitude (°E)", "longitude", "Longitude", "经度 (°N)", "经度", "lng")
LATITUDE_NAMES = ("LATITUDE", "Latitude (°N)", "latitude", "Latitude", "纬度 (°E)", "纬度", "lat")


def parse_ranges(text: str, n_columns: int) -> list[int]:
    """``"[1, 3]; 7"`` -> 1-based positions 1, 2, 3, 7: ascending and without repeats."""
    chosen: set[int] = set()
    for piece in (p.strip() for p in text.replace("；", ";").split(";")):
        if not piece:
            continue
        span = re.fullmatch(r"\[\s*(\d+)\s*,\s*(\d+)\s*\]", piece)
        if span:
            first, last = int(span.group(1)), int(span.group(2))
            if last < first:
                raise ValueError(f"range {piece} runs backwards")
            chosen.update(range(first, last + 1))
        elif piece.isdigit():
            chosen.add(int(piece))
        else:
            raise ValueError(f"cannot read column range {piece!r}")
    bad = [p for p in chosen if not 1 <= p <= n_columns]
    if bad or not chosen:
        raise ValueError(f"column positions out of 1..{n_columns}: {sorted(bad)}")
    return sorted(chosen)


def select_ranges(df: DataFrame, text: str) -> DataFrame:
    return df.select(*[c(df.columns[p - 1]) for p in parse_ranges(text, len(df.columns))])


def non_empty_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value, found in one pass."""
    row = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(df.columns)]).first()
    return [n for i, n in enumerate(df.columns) if row[f"n{i}"] > 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c(n) for n in non_empty_columns(df)])


def sub_table(
    df: DataFrame,
    ranges: str,
    allow_empty_columns: bool = False,
    require_numeric: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The chosen columns without empty ones; every remaining feature has to be numeric."""
    chosen = select_ranges(df, ranges)
    names = chosen.columns if allow_empty_columns else non_empty_columns(chosen)
    if not names:
        raise ValueError("every chosen column is empty")
    if require_numeric:
        numeric = set(numeric_columns(chosen))
        text = [n for n in names if n not in numeric]
        if text:
            raise ValueError(f"columns are not numeric: {text}")
    return df.select(*[c(n) for n in dict.fromkeys([*keep, *names])])


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[c(n) for n in dict.fromkeys([*keep, *numeric_columns(df)])])


def choose_axes(df: DataFrame, axes: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Two or three columns (1-based) for a diagram table."""
    names = [n for n in df.columns if n not in keep]
    if len(set(axes)) != len(axes) or not all(1 <= a <= len(names) for a in axes):
        raise ValueError("axes must be different column positions")
    return df.select(*[c(k) for k in keep], *[c(names[a - 1]) for a in axes])


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Plain IS NOT NULL filters, which reach the file scan (``na.drop`` does not)."""
    kinds = dict(df.dtypes)
    for n in subset or df.columns:
        df = df.filter(c(n).isNotNull() & ~F.isnan(c(n)) if kinds[n] in ("double", "float") else c(n).isNotNull())
    return df


def coordinate_columns(df: DataFrame) -> tuple[str | None, str | None]:
    lat = next((n for n in LATITUDE_NAMES if n in df.columns), None)
    lon = next((n for n in LONGITUDE_NAMES if n in df.columns), None)
    return lat, lon


def align(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Put the columns of two tables side by side by row key, never by position."""
    overlap = [n for n in right.columns if n in left.columns and n != row_id]
    if overlap:
        raise ValueError(f"columns on both sides: {overlap}")
    return left.join(right, row_id, "inner")


def flag_abnormal(df: DataFrame, label: str = "is_abnormal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, rows labelled 1 (normal) and rows labelled -1 (abnormal)."""
    return df, df.filter(c(label) == 1), df.filter(c(label) == -1)


def rows_of(df: DataFrame, members: DataFrame, on: str, present: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in another table."""
    return df.join(members.select(on), on, "left_semi" if present else "left_anti")


def distinct_in_order(df: DataFrame, value: str, row_order: str) -> DataFrame:
    """Distinct values in the order in which they first occur (smallest ``row_order``)."""
    return df.groupBy(c(value).alias(value)).agg(F.min(c(row_order)).alias("first_row"), F.count("*").alias("n"))
