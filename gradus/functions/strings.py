"""String parsing with the rules of the text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a character class.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"


def words(text: Column) -> Column:
    """Runs without white space; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def blank(line: Column) -> Column:
    return F.size(words(line)) == 0


def whole_number(text: Column) -> Column:
    """The number, or null. Underscores between digits aren't taken."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))


def finite(text: Column) -> Column:
    """The finite number, or null; no type suffixes, no hexadecimal."""
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def file_label(name: Column) -> Column:
    """A name as part of a file name: what is no ASCII letter or digit becomes an underscore."""
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")
