"""String expressions with the semantics of Unicode-aware scripts rather than of SQL defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; other letters separate words."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut at white space after a full stop, exclamation or question mark."""
    pieces = F.transform(F.split(strip(c), r"(?<=[.!?])(?U)\s+"), strip)
    return F.filter(pieces, lambda s: s != "")


def number(c: Column) -> Column:
    """A number with a decimal comma or point; null if it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def plain_number(c: Column) -> Column:
    """Text of a number, a whole one without decimals."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it took no part."""
    return F.nullif(F.regexp_extract(c, f"{FLAGS}(?s){pattern}", group), F.lit(""))


def contains_token(c: Column, needle: str, separator: str = ",") -> Column:
    """Whether a list in one text has exactly this item."""
    return F.coalesce(F.array_contains(F.transform(F.split(c, separator), lambda x: F.trim(x)), needle), F.lit(False))


def hyphen_wrapped(line: Column, following: Column) -> Column:
    """Whether a line ends with a letter and a hyphen and the next one goes on in lower case."""
    return line.rlike(r"(?U)\p{L}-\s*$") & following.rlike(r"(?U)^\s*\p{Ll}")


def hyphen_joined(line: Column, following: Column) -> Column:
    """Two lines as one: glued over a wrapped hyphen, else with a space between."""
    glued = F.concat(F.regexp_replace(line, r"(?U)-\s*$", ""), F.regexp_replace(following, r"(?U)^\s+", ""))
    return F.when(hyphen_wrapped(line, following), glued).otherwise(F.concat_ws(" ", line, following))
