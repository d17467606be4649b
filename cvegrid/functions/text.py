"""Small text expressions shared by the readers and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      "
    "          　"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def stripped_or_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def format_duration(seconds: Column) -> Column:
    """Whole minutes and seconds, such as 3m07s; fractions are cut off."""
    whole = F.floor(seconds).cast("bigint")
    rest = F.lpad((whole % 60).cast("string"), 2, "0")
    return F.concat(F.floor(whole / 60).cast("bigint").cast("string"), F.lit("m"), rest, F.lit("s"))


def cut_text(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters, marked with an ellipsis when cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
