"""Cell values of source databases, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that the unsigned integer types keep.
UNSIGNED_MASK = {"tinyint": 0xFF, "smallint": 0xFFFF, "mediumint": 0xFFFFFF, "int": 0xFFFFFFFF}


def enum_label(ordinal: Column, labels: list[str]) -> Column:
    """1-based label; 0 is the empty label, and beyond the list there is none."""
    return F.when(ordinal == 0, F.lit("")).otherwise(F.get(F.array(*map(F.lit, labels)), (ordinal - 1).cast("int")))


def set_labels(mask: Column, labels: list[str]) -> Column:
    """Labels of the bits that are set, joined by commas."""
    bits = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(labels)]
    return F.concat_ws(",", *bits)


def unsigned(value: Column, kind: str) -> Column:
    """The unsigned reading of a signed integer."""
    if kind == "bigint":
        wide = value.cast("decimal(20,0)")
        return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    return value.cast("bigint").bitwiseAND(F.lit(UNSIGNED_MASK[kind]))


def bit_bytes(value: Column, bits: int) -> Column:
    """Big-endian bytes of a BIT(n) value."""
    return F.unhex(F.lpad(F.hex(value), 2 * -(-bits // 8), "0"))


def hex_bytes(text: Column) -> Column:
    """Bytes of ``0x...`` text."""
    return F.when(text.rlike("^0[xX]([0-9a-fA-F]{2})*$"), F.unhex(F.substring(text, 3, 1 << 30)))


def small_boolean(value: Column) -> Column:
    """tinyint(1) as a boolean; null where it is neither."""
    said = F.lower(value.cast("string"))
    return F.when(said.isin("1", "true", "t"), True).when(said.isin("0", "false", "f"), False)


def signed_time(millis: Column) -> Column:
    """``[-]HH:MM:SS`` of milliseconds, beyond a day too."""
    s = F.abs(millis).cast("bigint")
    of = lambda unit, most: F.lpad((F.floor(s / unit) % most if most else F.floor(s / unit)).cast("string"), 2, "0")
    hours = F.floor(s / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(F.when(millis < 0, "-").otherwise(""), hours, F.lit(":"), of(60_000, 60), F.lit(":"), of(1000, 60))


def without_zone(text: Column) -> Column:
    """A time text without its trailing offset."""
    return F.regexp_replace(text, r"[+-]\d{2}(:?\d{2})?$", "")


def array_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", ", "null"), F.lit("]"))


def row_bytes(*columns: Column, kinds: list[str]) -> Column:
    """Estimated size of a row in a load batch: nulls 1, bytes their length, characters 3 each, numbers 8, else 24."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    sizes = [F.when(c.isNull(), 1).otherwise(F.octet_length(c) if k == "binary" else 3 * F.char_length(c) if k == "string" else F.lit(8 if k in numbers or k.startswith("decimal") else 24)) for c, k in zip(columns, kinds, strict=True)]
    return sum(sizes[1:], sizes[0]).cast("bigint")
