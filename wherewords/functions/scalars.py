"""Numeric, time and hash functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of_day(created_at: Column) -> Column:
    """Seconds since midnight of a timestamp (session time zone)."""
    return F.hour(created_at) * 3600 + F.minute(created_at) * 60 + F.second(created_at)


def seconds_of_day_text(created_at: Column) -> Column:
    """The same for a ``"<date> HH:MM:SS"`` text."""
    clock = F.split(F.get(F.split(created_at, " "), F.lit(1)), ":")
    return (
        F.get(clock, F.lit(0)).try_cast("int") * 3600
        + F.get(clock, F.lit(1)).try_cast("int") * 60
        + F.get(clock, F.lit(2)).try_cast("int")
    )


def int_key(value: Column) -> Column:
    return value.try_cast("int")


def lat_lon(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def hash_number(key: Column, seed: int | None = None) -> Column:
    """A 32-bit number (as bigint) from the md5 of the key: the same on every
    engine and in every run, unlike a random sample."""
    text = key.cast("string")
    if seed is not None:
        text = F.concat(text, F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, buckets: int, seed: int | None = None) -> Column:
    return hash_number(key, seed) % buckets


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two numeric arrays of equal length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one of them is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
