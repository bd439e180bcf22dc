"""Scalar functions on texts, times and loosely typed values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_tokens(text: Column, n: Column, from_end: bool = False) -> Column:
    """At most n tokens of four characters, from the beginning or from the end."""
    chars = (n * 4).cast("int")
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(text, F.greatest(F.lit(1), F.length(text) - chars + 1), chars) if from_end else F.substring(text, F.lit(1), chars))


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as ISO 8601 in UTC, to the second."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def spoken_time(c: Column) -> Column:
    """Seconds since 1970 of times such as `1:56 pm on 8 May, 2023`, taken as UTC; null for anything else."""
    shape = c.rlike(r"(?i)^\d{1,2}:\d\d [ap]m on \d{1,2} \p{L}{3,9}, \d{4}$")
    said = F.regexp_replace(F.regexp_replace(F.upper(c), " ON ", " "), r"( \d{1,2} \p{L}{3})\p{L}*", "$1")
    plain = F.initcap(F.lower(said))  # month names begin with a capital
    t = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(plain, "Am ", "AM "), "Pm ", "PM "), F.lit("h:mm a d MMM, yyyy"))
    return F.when(shape, F.unix_timestamp(t))


def lenient_int(c: Column, bad: int | None = None) -> Column:
    """Whole numbers of texts, fractions cut off; `bad` for anything else."""
    return F.coalesce(lenient_float(c).try_cast("bigint"), F.lit(bad).cast("bigint"))


def lenient_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def safe_id(c: Column) -> Column:
    """A name for a file: letters, digits, dots, hyphens and underscores stay, others become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors of one length; null for none."""
    n = F.size(vectors)
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double") * 0)
    total = F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))
