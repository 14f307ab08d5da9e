"""Order of text as a reader expects it (Q-6): by the Unicode collation, not by bytes.

Two texts that the collation takes for equal are put in order by their bytes, so every order is total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLATION = "UNICODE"
#: Texts of these characters alone have the same order by bytes as by the collation.
_PLAIN = "[^a-z0-9 /-]"


def local(text: Column | str) -> Column:
    """The text under the collation, for comparisons and sorts."""
    return F.collate(text, COLLATION)


def named(*columns: Column | str) -> list[Column]:
    """Sort keys of text columns, ascending."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return [key for c in map(as_column, columns) for key in (local(c), c)]


def sorted_texts(texts: Column) -> Column:
    """An array of texts in order; plain ones need no collation."""

    def compare(a: Column, b: Column) -> Column:
        return F.when(local(a) < local(b), -1).when(local(a) > local(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.when(F.array_join(texts, "").rlike(_PLAIN), F.array_sort(texts, compare)).otherwise(F.array_sort(texts))
