"""Value cleaning, dates, ratios and flags as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(col: Column | str) -> Column:
    """H2: number or null; the pattern keeps out Java-only spellings such as ``1d`` or ``NaN``."""
    c = _col(col).cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def clean_censored(col: Column | str, mode: str = "limit") -> Column:
    """H1: numeric value of a raw result text.

    ``limit``: ``<x`` gives x, for any number x. ``int_minus_one``: ``<n`` gives n - 1 for whole n
    and null otherwise. Text made of letters only is null in both.
    """
    c = _col(col)
    rest = F.substr(c, F.lit(2))
    if mode == "limit":
        censored = to_number(rest)
    elif mode == "int_minus_one":
        censored = F.when(rest.rlike(r"^\s*[+-]?\d+\s*$"), rest.try_cast("bigint") - F.lit(1)).cast("double")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(c.startswith("<"), censored).when(~c.rlike(r"^\p{L}+$"), to_number(c))


def is_censored(col: Column | str) -> Column:
    """H1: 1 where the raw text is a below-limit result."""
    return F.coalesce(_col(col).startswith("<"), F.lit(False)).cast("int")


def decimal_comma(col: Column | str) -> Column:
    """H3: decimal comma to decimal point."""
    return F.replace(_col(col), F.lit(","), F.lit("."))


def parse_ts(col: Column | str, formats: Sequence[str]) -> Column:
    """H4: first format that fits; null where none does."""
    c = _col(col)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def to_day(col: Column | str) -> Column:
    """H5: calendar day."""
    return F.to_date(_col(col))


def to_epoch(col: Column | str) -> Column:
    """H6: whole seconds since 1970 of the day or time (session zone UTC)."""
    return F.unix_timestamp(_col(col).cast("timestamp"))


def from_epoch(col: Column | str) -> Column:
    """H6: inverse of ``to_epoch``."""
    return F.timestamp_seconds(_col(col))


def time_of_day(col: Column | str) -> Column:
    """H7: time of day as text."""
    return F.date_format(_col(col), "HH:mm:ss")


def null_if_in(col: Column | str, values: Sequence) -> Column:
    """H8: sentinel values become null."""
    c = _col(col)
    return F.when(~c.isin(*values), c)


def bmi(weight_kg: Column | str, height_m: Column | str) -> Column:
    """H9: kg / m²; null for a zero height."""
    return F.try_divide(_col(weight_kg), F.pow(_col(height_m), F.lit(2)))


def cm_to_m(col: Column | str) -> Column:
    """H9: centimetres to metres."""
    return _col(col) / F.lit(100)


def fill_or_set(df: DataFrame, name: str, value: Column, mode: str = "fill") -> DataFrame:
    """Fill a column where it is null, or overwrite it always."""
    if mode not in ("fill", "set"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn(name, value if mode == "set" else F.coalesce(F.col(name), value))


def strict_int(col: Column | str) -> Column:
    """Cast that raises on text that is no integer (ANSI)."""
    return _col(col).cast("bigint")


def slot_label(item: Column | str, slot: Column | str) -> Column:
    """Item name followed by the first digit of the slot name."""
    return F.concat_ws(" ", _col(item), F.regexp_extract(_col(slot), r"(\d)", 1))


def map_values(col: Column | str, mapping: Mapping) -> Column:
    """Lookup of a few categories; anything else is null."""
    c = _col(col)
    out = None
    for key, value in mapping.items():
        cond = c == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


def missing_flags(df: DataFrame, cols: Sequence[str], prefix: str = "missing_") -> DataFrame:
    """One 0/1 column per input column."""
    return df.withColumns({prefix + c: F.col(c).isNull().cast("int") for c in cols})


def pct_from(value: Column | str, base: Column | str) -> Column:
    """Percent change from a baseline; null without a usable baseline."""
    v, b = _col(value), _col(base)
    return F.when(b != 0, (v - b) / b * F.lit(100))


def to_binary(col: Column | str, positive) -> Column:
    """1 where the value equals ``positive``, else 0."""
    return F.coalesce(_col(col) == F.lit(positive), F.lit(False)).cast("int")


def fill_value(col: Column | str, value) -> Column:
    """Constant for null."""
    return F.coalesce(_col(col), F.lit(value))


def with_flags(df: DataFrame, **constants) -> DataFrame:
    """Constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def model_id(kind: str, params: Mapping[str, Column | str]) -> Column:
    """``kind (name=value, …)`` built from parameter columns."""
    parts = [F.concat(F.lit(name + "="), _col(col).cast("string")) for name, col in params.items()]
    return F.concat(F.lit(kind + " ("), F.concat_ws(", ", *parts), F.lit(")"))


def file_safe(col: Column | str) -> Column:
    """Blanks to ``_``, ``=`` to ``-``, brackets and commas removed."""
    return F.regexp_replace(F.translate(_col(col), " =", "_-"), r"[(),]", "")
