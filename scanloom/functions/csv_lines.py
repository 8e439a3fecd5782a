"""The parsing of CSV scan lines, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def tokens(line: Column) -> Column:
    """Trimmed comma-separated tokens; blank ones are skipped."""
    return F.filter(F.transform(F.split(line, ",", -1), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def pixel(token: Column) -> Column:
    """The token's leading integer modulo 256; no integer, or one beyond 32 bits, is an error."""
    return F.pmod(F.regexp_extract(token, r"^([+-]?\d+)", 1).cast("int"), F.lit(256)).cast("int")


def pixels(line: Column) -> Column:
    return F.transform(tokens(line), pixel)
