"""Timestamp columns: strict parsing, precision, calendar parts, lags, reading time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
STRICT = r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2}))?)?$"


def parse_timestamp(text: Column) -> Column:
    """A timestamp of exactly YYYY-MM-DD[ HH:MM[:SS]]; null for anything else and for dates that do not exist."""
    value = F.trim(text)
    part = lambda k: F.coalesce(F.expr("1") * 0 + F.try_to_number(F.nullif(F.regexp_extract(value, STRICT, k), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
    made = F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))
    return F.when(value.rlike(STRICT) & (part(6) < 60), made)


def precision(text: Column) -> Column:
    """`datetime` if hours and minutes are given, else `date`; null if the text is no strict timestamp."""
    value = F.trim(text)
    return F.when(parse_timestamp(text).isNotNull(), F.when(F.length(value) > 10, F.lit("datetime")).otherwise(F.lit("date")))


def decompose(ts: Column, kind: Column) -> Column:
    """The parts of a timestamp as a struct; weekday 0 is Sunday. The timestamp and its kind are worked out once."""
    return F.get(F.transform(F.array(F.struct(ts.alias("ts"), kind.alias("kind"))), lambda x: _parts(x["ts"], x["kind"])), F.lit(0))


def _parts(ts: Column, kind: Column) -> Column:
    label = F.when(kind == "datetime", F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return F.when(
        ts.isNotNull(),
        F.struct(
            label.alias("normalized_local"), kind.alias("precision"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"),
            F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), weekday(ts).alias("weekday"), F.unix_millis(ts).alias("epoch_millis"),
        ),
    )


def resolve(text: Column, has_key: Column, fallback: Column, name: str) -> Column:
    """struct(value, source, issue): the strict text, or the file's own time with `invalid` or `missing`."""
    parsed, file_time = parse_timestamp(text), F.when(F.unix_millis(fallback) > 0, fallback)
    own = F.struct(decompose(parsed, precision(text)).alias("value"), F.lit("frontmatter").alias("source"), F.lit(None).cast("string").alias("issue"))
    file_value = decompose(file_time, F.lit("datetime"))
    invalid = F.struct(file_value.alias("value"), F.lit(f"filesystem-{name}").alias("source"), F.lit("invalid").alias("issue"))
    missing = F.struct(file_value.alias("value"), F.when(file_time.isNull(), F.lit("unresolved")).otherwise(F.lit(f"filesystem-{name}")).alias("source"), F.lit("missing").alias("issue"))
    return F.when(parsed.isNotNull(), own).when(has_key, invalid).otherwise(missing)


def weekday(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def monday_first(sunday_first: Column) -> Column:
    return (sunday_first + 6) % 7


def epoch_day(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def local_label(ts: Column) -> Column:
    """T6. `2021-03-04`, or `2021-03-04T05:06` for a moment that is not midnight."""
    day = (F.hour(ts) == 0) & (F.minute(ts) == 0)
    return F.when(day, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))


def instant_day(ts: Column) -> Column:
    """T8. The UTC day of a moment, whatever the session's time zone; epoch_day() is the day on the calendar there."""
    return F.floor(F.unix_millis(ts.cast("timestamp")) / DAY).cast("int")


def season(month: Column) -> Column:
    """0 December to February, 1, 2, 3."""
    return F.floor((month % 12) / 3).cast("int")


def lag_days(created: Column, updated: Column, whole: bool = False) -> Column:
    """Days from creation to revision; null if it came before or is unknown."""
    days = (F.unix_millis(updated) - F.unix_millis(created)) / F.lit(DAY)
    return F.when(updated >= created, F.floor(days) if whole else days)


def reading_minutes(words: Column, per_minute: int) -> Column:
    return F.when(words > 0, words / F.lit(float(per_minute))).otherwise(F.lit(0.0))


def note_depth(minutes: Column, lag: Column) -> Column:
    return minutes * (1 + F.log1p(F.greatest(F.lit(0.0), F.coalesce(lag, F.lit(0.0)))) / 4)


def reading_label(minutes: Column) -> Column:
    """N min, H h M min or D d H h."""
    n = F.floor(minutes + 0.5)
    hours = F.floor(n / 60)
    return F.when(n < 60, F.concat(n.cast("string"), F.lit(" min"))).when(hours < 24, F.concat(hours.cast("string"), F.lit(" h "), (n % 60).cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d "), (hours % 24).cast("string"), F.lit(" h")))


def elapsed_label(ms: float) -> str:
    """A run's duration for people."""
    if ms < 1000:
        return f"{round(ms)} ms"
    seconds = ms / 1000
    if seconds < 60:
        return f"{seconds:.1f} s"
    minutes, rest = divmod(int(seconds + 0.5), 60)
    return f"{minutes} min {rest} s" if minutes < 60 else f"{minutes // 60} h {minutes % 60} min"
