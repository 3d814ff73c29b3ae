"""Small string hashes, on ASCII or Latin text (characters of one UTF-16 unit)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def _fold(text: Column, start: int, step) -> Column:
    return F.aggregate(_units(text), F.lit(start).cast("long"), step)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a, unsigned."""
    return _fold(text, 2166136261, lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a_abs(text: Column) -> Column:
    """32-bit FNV-1a, signed, without its sign."""
    h = fnv1a(text)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def rolling31_hex(text: Column) -> Column:
    """h * 31 + c modulo 2^32, in hex."""
    return F.lower(F.hex(_fold(text, 0, lambda h, c: (h * 31 + c.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
