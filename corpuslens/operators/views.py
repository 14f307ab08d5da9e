"""How tables are shown: row limits, sorting with nulls last, search, labels and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limited(rows: DataFrame, override: int | None, default: int) -> DataFrame:
    """O10. The override, or else the default, as the number of rows; 0 and less: all."""
    k = override if override is not None else default
    return rows if k <= 0 else rows.limit(k)


def sorted_by(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """O12. Nulls last in both directions; text without regard to case, runs of digits by their value."""
    if dict(rows.dtypes)[column] == "string":
        # Digit runs are padded, so that text order is number order.
        padded = F.regexp_replace(F.lower(column), r"(\d+)", "0000000000000000000$1")
        key = F.regexp_replace(padded, r"0+(\d{20})", "$1")
    else:
        key = F.col(column)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def search(rows: DataFrame, query: str, keywords: Column | None = None) -> DataFrame:
    """V1. Rows whose cells, or keywords, hold the trimmed query, whatever its case; an empty query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    cells = [F.col(f"`{c}`").cast("string") for c in rows.columns]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *cells, *([keywords] if keywords is not None else []))), F.lit(wanted)))


def share_label(first: Column, first_share: Column, second: Column, second_share: Column, between: str = " | ") -> Column:
    """V5. `A (60%) | B (40%)`, without what has no share; `(none)` if neither has."""
    one = lambda label, share: F.when(label.isNotNull() & (share > 0), F.concat(label, F.lit(" ("), F.floor(share * 100 + 0.5).cast("string"), F.lit("%)")))
    both = F.concat_ws(between, one(first, first_share), one(second, second_share))
    return F.when(both == "", "(none)").otherwise(both)


def wiki_link(path: Column) -> Column:
    """V6. `[[path|name]]` without the extension."""
    bare = F.regexp_replace(path, r"(?i)\.md$", "")
    return F.concat(F.lit("[["), bare, F.lit("|"), F.substring_index(bare, "/", -1), F.lit("]]"))


def histogram_label(low: Column, high: Column) -> Column:
    """H14. `start-end`, the end inclusive; one value for a bin of width 1."""
    number = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.format_string("%.1f", v.cast("double")))
    last = F.greatest(low, high - 1)
    return F.when(last <= low, number(low)).otherwise(F.concat(number(low), F.lit("-"), number(last)))


def span_label(first: Column, last: Column) -> Column:
    """H17. `a` or `a-b`."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
