"""Column expressions for text: trimming, number printing, number cleaning, row text."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import col, value

# Everything Python calls white space. Java's \s is ASCII only, so it is spelled out.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

STORED_TEXT_LIMIT = 500

_NON_ASCII_DIGITS = [
    chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None
]
_DIGITS_FROM = "".join(_NON_ASCII_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _NON_ASCII_DIGITS)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def stored_text(c: Column, limit: int | None = STORED_TEXT_LIMIT) -> Column:
    """The prefix that is kept for display, or all with None; vectors are always made from the full text."""
    return c if limit is None else F.substring(c, 1, limit)


def fixed_text(c: Column, digits: int) -> Column:
    """A double with so many decimals as Python prints it, ties decided by its exact value.

    Spark rounds the shortest decimal form half up, which differs. Meant for the few figures of an answer.
    """

    @F.arrow_udf(T.StringType())
    def fixed(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return fixed(c.cast("double"))


def clean_number(c: Column) -> Column:
    """Read a malformed numeric string as a double, null where nothing can be read.

    ``5-`` is -5, ``$ 1,234.5`` is 1234.5, ``1.2.3`` is 1.2, ``5-LOW`` is null.
    """
    s = c.cast("string")
    s = F.when(s.rlike(r"[^\x00-\x7f]"), F.translate(s, _DIGITS_FROM, _DIGITS_TO)).otherwise(s)
    s = F.regexp_replace(strip(s), r"(?s)^(.*)-\z", "-$1")
    s = F.regexp_replace(s, r"[^0-9.\-eE+]", "")
    # With two points, or two dashes and none in front, the leading number is taken alone.
    s = F.regexp_replace(s, r"^(?=.*\..*\.|[^-].*-.*-)(-?[0-9]+\.?[0-9]*).*\z", "$1")
    return s.try_cast("double")


def double_text(c: Column) -> Column:
    """A double in Python's spelling: positional from 1e-4 up to 1e16, else ``d.ddde+XX``."""
    s = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0*$", "$1")
    scientific = F.regexp_replace(s, r"(\.0)?E", "e")
    scientific = F.regexp_replace(scientific, r"e([0-9])", r"e+$1")
    scientific = F.regexp_replace(scientific, r"(?<sign>e[+-])(?<digit>[0-9])$", r"${sign}0${digit}")
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == math.inf, F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~s.contains("E"), s)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def printed(c: Column, dtype: T.DataType) -> Column:
    """A cell as Python prints it; null stays null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``"name: cell | name: cell"`` over the non-null cells of a row.

    In a table of numbers only, one floating column makes every whole number print
    as a float (a row then has a single numeric type).
    """
    names = list(columns if columns is not None else df.columns)
    types = [df.schema[n].dataType for n in names]
    floating = (T.DoubleType, T.FloatType)
    upcast = all(isinstance(t, T.NumericType) for t in types) and any(isinstance(t, floating) for t in types)
    cells = []
    for name, dtype in zip(names, types):
        c = value(df, name)
        if upcast and not isinstance(dtype, floating):
            c, dtype = c.cast("double"), T.DoubleType()
        cells.append(F.concat(F.lit(f"{name}: "), printed(c, dtype)))
    return F.concat_ws(" | ", *cells)
