"""Time series in arrays: causal cuts, padding, calendar parts, deltas, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("second", "minute", "hour", "day_of_week", "month", "year")


def calendar(t: Column) -> dict[str, Column]:
    """Parts of epoch seconds in UTC; Monday is 0, negative times count back correctly."""
    stamp = F.timestamp_seconds(t)
    return {
        "second": F.pmod(t, F.lit(60)),
        "minute": F.pmod(F.floor(t / 60), F.lit(60)),
        "hour": F.pmod(F.floor(t / 3600), F.lit(24)),
        "day_of_week": F.pmod(F.floor(t / 86400) + 3, F.lit(7)),
        "month": F.month(stamp),
        "year": F.year(stamp),
    }


def parse_micros(text: Column) -> Column:
    """Microseconds since 1970 of a written time; without an offset it is UTC, and what is no time is null."""
    zoned = F.when(text.rlike(r"(?i)(?:[+-]\d{2}:?\d{2}|Z)$") & text.contains(":"), text).otherwise(F.concat(text, F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit(""))))
    plain = F.to_date(F.try_to_timestamp(text))
    return F.when(text.contains(":"), F.unix_micros(F.try_to_timestamp(zoned))).otherwise(F.unix_date(plain).cast("long") * 86_400_000_000)


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s``, or seconds with two decimals below a minute."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.floor(F.pmod(seconds, F.lit(60)))
    part = lambda x: x.cast("long").cast("string")
    long = F.concat(part(h), F.lit("h "), part(m), F.lit("m "), part(s), F.lit("s"))
    return F.when(h > 0, long).when(m > 0, F.concat(part(m), F.lit("m "), part(s), F.lit("s"))).otherwise(F.format_string("%.2fs", seconds.cast("double")))


def indented(text: Column, spaces: int = 8) -> Column:
    """Stripped text whose further lines begin with so many blanks."""
    return F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit("\n" + " " * spaces))


def calendar_columns(df: DataFrame, column: str, is_array: bool = False) -> DataFrame:
    if not is_array:
        return df.withColumns({f"{column}_{p}": c for p, c in calendar(F.col(column)).items()})
    return df.withColumns({f"{column}_{p}": F.transform(column, _part(p)) for p in PARTS})


def _part(name: str):
    return lambda t: calendar(t)[name]


def seed_delta(time: Column, seed_time: Column, mask: Column | None = None, fill: int = 0) -> Column:
    """Seed time minus each time; where the mask is false, the fill value."""
    if mask is None:
        return F.transform(time, lambda t: seed_time - t)
    return F.zip_with(time, mask, lambda t, m: F.when(m, seed_time - t).otherwise(F.lit(fill)))


def last_steps(values: Column, length: int) -> Column:
    """The most recent ``length`` steps."""
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - length + 1), F.lit(length))


def pad_and_cap(values: Column, length: int = 30, fill: Column | int = 0) -> Column:
    """The last ``length`` steps, padded on the left."""
    fill = F.lit(fill) if isinstance(fill, int) else fill
    kept = last_steps(values, length)
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(values))), kept)


def step_mask(values: Column, length: int = 30) -> Column:
    """True where ``pad_and_cap`` holds an observed step."""
    seen = F.least(F.size(values), F.lit(length))
    return F.concat(F.array_repeat(F.lit(False), F.lit(length) - seen), F.array_repeat(F.lit(True), seen))


def causal_cut(times: Column, values: Column, until: Column, longest: int | None = None) -> Column:
    """The values whose time is not after ``until``, at most the last ``longest``."""
    pairs = F.filter(F.arrays_zip(times.alias("t"), values.alias("v")), lambda x: x["t"] <= until)
    kept = F.transform(pairs, lambda x: x["v"])
    return last_steps(kept, longest) if longest else kept


def masked(values: Column, mask: Column, fill) -> Column:
    return F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(fill)))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean over observed steps, 0 if there are none."""
    shown = F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0))
    total = F.aggregate(shown, F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate(mask, F.lit(0), lambda s, m: s + F.when(m, 1).otherwise(0))
    return total / F.greatest(seen, F.lit(1))


def series(df: DataFrame, key: str, time: str, values: list[str], most: int | None = None) -> DataFrame:
    """Rows of events as one row a key with arrays ordered by time, then values.

    With ``most`` only the last so many steps are gathered: each task cuts its keys to them
    before the shuffle, so no array or task holds a key's whole history.  Without it an array does.
    """
    if most:
        line = Window.partitionBy(key).orderBy(*[F.desc(c) for c in (time, *values)])
        df = df.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= most)
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time, *values))).alias("__s"))
    return g.select(key, *[F.col(f"__s.{c}").alias(c) for c in (time, *values)])
