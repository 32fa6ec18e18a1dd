"""Splitting a log line into fields.

A double quote toggles quoting wherever it stands and is never part of a
field; a comma separates fields only outside quotes; an open quote runs to the
end of the line. This is not the CSV quoting rule, hence no ``from_csv``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quoted commas travel through the split as MARK+"b", a MARK of the line itself
# as MARK+"a"; ``reveal`` turns both back, so no character is reserved.
MARK = "\u0001"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def hidden_fields(line: Column) -> Column:
    """Fields of ``line`` as an array whose items still need ``reveal``."""
    marked = _replace(line, MARK, MARK + "a")
    pieces = F.split(marked, '"', -1)
    hidden = F.transform(
        pieces,
        lambda piece, i: F.when(i % 2 == 1, _replace(piece, ",", MARK + "b")).otherwise(piece),
    )
    unquoted = F.when(F.contains(line, F.lit('"')), F.array_join(hidden, "")).otherwise(marked)
    return F.split(unquoted, ",", -1)


def reveal(field: Column) -> Column:
    """The text of one item of ``hidden_fields``."""
    return _replace(_replace(field, MARK + "b", ","), MARK + "a", MARK)


def split_fields(line: Column) -> Column:
    """All fields of ``line`` as an array of strings; an empty line is one empty field."""
    return F.transform(hidden_fields(line), reveal)
