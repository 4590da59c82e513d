"""Result sinks: JSON and spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.texts import guard_formula, is_sensitive


def valid_field_name(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_]{1,40}$") & ~is_sensitive(name)


def csv_safe(rows: DataFrame) -> DataFrame:
    """Guard string cells and headers against formulas; other types are left as they are."""
    out = []
    for f in rows.schema.fields:
        cell = guard_formula(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        name = "'" + f.name if f.name.lstrip()[:1] in ("=", "+", "-", "@") else f.name
        out.append(cell.alias(name))
    return rows.select(*out)


BYTE_ORDER_MARK = "\ufeff"


def write_csv(rows: DataFrame, path: str, *, mode: str = "errorifexists", mark: bool = True) -> None:
    """UTF-8 CSV parts with CRLF lines, each with a header behind a byte-order mark, as spreadsheets expect; NULL becomes an empty cell."""
    safe = csv_safe(rows)
    if mark and safe.columns:
        safe = safe.toDF(BYTE_ORDER_MARK + safe.columns[0], *safe.columns[1:])
    (safe.write.mode(mode).option("header", True).option("lineSep", "\r\n").option("nullValue", "")
     .option("emptyValue", "").option("escape", '"').option("encoding", "UTF-8").csv(path))


def refuse_non_finite(rows: DataFrame) -> DataFrame:
    """Fail the job on the first NaN or infinite number instead of writing it."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.raise_error(F.lit("non_finite_number"))).otherwise(c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def write_json(rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines; the committer publishes all parts or none."""
    refuse_non_finite(rows).write.mode(mode).option("ignoreNullFields", False).json(path)
