"""Text expressions: stripping, literal replacement, currency and prefix+number identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# CSV cells that mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: the spellings of a boolean, case by case.
BOOLEAN_MAP = {
    "yes": True, "Yes": True, "YES": True,
    "no": False, "No": False, "NO": False,
    "true": True, "True": True, "TRUE": True,
    "false": False, "False": False, "FALSE": False,
    "1": True, "0": False,
}

# Lower-case cells that make a column look boolean.
BOOLEAN_WORDS = ("yes", "no", "true", "false", "1", "0")


def strip(c: Column) -> Column:
    """Drop leading and trailing white space; ``trim`` alone would leave tabs."""
    return F.btrim(c, F.lit(WHITESPACE))


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a cell, the same wherever cells are shown or compared: True and False, and
    floating numbers in plain digits up to 1e16."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        written, size = c.cast("string"), F.abs(c)
        plain = F.regexp_replace(F.regexp_replace(written.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"[.]$", ".0")
        return F.when(F.contains(written, F.lit("E")) & (size < 1e16) & (size >= 1e-4), plain).otherwise(written)
    return c.cast("string")


def null_tokens(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def strip_currency(c: Column) -> Column:
    return F.translate(c, "$,", "")


def id_digits(c: Column) -> Column:
    """The trailing digit run of an identifier, '' if there is none."""
    return F.regexp_extract(c, r"^.*?([0-9]+)$", 1)


def id_prefix(c: Column, digits: Column) -> Column:
    """What stands before the trailing digits; NULL if there are no digits."""
    return F.when(digits != "", F.left(c, F.length(c) - F.length(digits)))


def id_text(prefix: str, number: Column, width: int) -> Column:
    """Prefix and number, zero-padded to ``width`` but never cut down to it."""
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return F.concat(F.lit(prefix), padded)
