"""Settings from text: what doesn't parse gives the fallback."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def int_setting(raw: Column, fallback: int) -> Column:
    """The number that the text begins with, if it is positive."""
    n = F.nullif(F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(fallback).cast("long"))


def float_setting(raw: Column, fallback: float) -> Column:
    n = F.nullif(F.regexp_extract(raw, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")
    return F.coalesce(n, F.lit(fallback))


# Spellings of true and false.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def bool_setting(raw: Column, fallback: bool) -> Column:
    low = F.lower(trim(raw))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).otherwise(fallback)


def list_setting(raw: Column, fallback: list[str]) -> Column:
    parts = F.filter(F.transform(F.split(raw, ","), trim), lambda x: x != "")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array(*map(F.lit, fallback))).otherwise(parts)
