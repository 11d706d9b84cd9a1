"""Masks for personal data, as column expressions on strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def stars(n: Column | int) -> Column:
    return F.repeat(F.lit("*"), n if isinstance(n, Column) else F.lit(n))


def full(v: Column) -> Column:
    return stars(F.least(F.length(v), F.lit(8)))


def ends(v: Column, head: int, tail: int, least: int, between: Callable[[Column], Column]) -> Column:
    """First and last characters around a mask; texts that are too short are masked whole."""
    return F.when(F.length(v) < least, full(v)).otherwise(F.concat(F.substring(v, 1, head), between(F.length(v)), F.right(v, F.lit(tail))))


def phone(v: Column) -> Column:
    return ends(v, 3, 4, 7, lambda n: F.lit("****"))


def id_card(v: Column) -> Column:
    return ends(v, 6, 4, 10, lambda n: stars(n - 10))


def bank_card(v: Column) -> Column:
    return ends(v, 4, 4, 8, lambda n: stars(n - 8))


def partial(v: Column) -> Column:
    return F.when(F.length(v) <= 2, full(v)).otherwise(F.concat(F.substring(v, 1, 1), stars(F.length(v) - 2), F.right(v, F.lit(1))))


def email(v: Column) -> Column:
    at = F.instr(v, "@")
    return F.when(at <= 1, full(v)).otherwise(F.concat(F.substring(v, 1, 1), F.lit("***"), v.substr(at, F.length(v))))


def digest(v: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(v, 256)


MASKS: dict[str, Callable[[Column], Column]] = {"phone": phone, "id_card": id_card, "email": email, "bank_card": bank_card, "full": full, "partial": partial, "hash": digest}

#: What a string looks like, tried in this order.
LOOKS = [("phone", r"^1[3-9]\d{9}$"), ("id_card", r"^\d{17}[\dXx]$"), ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), ("bank_card", r"^\d{16,19}$")]


def detected(v: Column) -> Column:
    """Masked as what it looks like, else unchanged."""
    out = v
    for name, pattern in reversed(LOOKS):
        out = F.when(v.rlike(pattern), MASKS[name](v)).otherwise(out)
    return out


def masked(name: str, v: Column, rules: dict[str, str]) -> Column:
    """By the field's rule (in any case of its name), else by its looks."""
    rule = {k.lower(): r for k, r in rules.items()}.get(name.lower())
    return MASKS[rule](v) if rule else detected(v)
