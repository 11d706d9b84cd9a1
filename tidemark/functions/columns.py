"""Row filters and column rules, as column expressions."""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

OPERATORS = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


@dataclass(frozen=True)
class Exclusion:
    """Rows whose ``column`` compares so with ``value`` are dropped."""

    column: str
    op: str
    value: str

    @staticmethod
    def parse(text: str) -> list[Exclusion]:
        """``col|op|value;...``; a malformed rule is an error."""
        out = []
        for rule in filter(None, (r.strip() for r in text.split(";"))):
            parts = [p.strip() for p in rule.split("|", 2)]
            if len(parts) != 3 or parts[1] not in OPERATORS or not parts[0]:
                raise ValueError(f"not a row rule: {rule!r}")
            out.append(Exclusion(*parts))
        return out


def excluded(df: DataFrame, rule: Exclusion) -> Column:
    """Whether a rule excludes a row: by number or time where both sides are, else by text. Null compares with nothing."""
    names = {c.lower(): c for c in df.columns}
    if rule.column.lower() not in names:
        return F.lit(False)
    name = names[rule.column.lower()]
    kind, column, compare = dict(df.dtypes)[name], df[name], OPERATORS[rule.op]
    number = re.fullmatch(r"[+-]?\d+(\.\d+)?", rule.value)
    if kind == "boolean":
        found = compare(column.cast("int"), F.lit(rule.value).try_cast("int")) if number else compare(column, F.lit(rule.value).try_cast("boolean"))
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        # A plain literal, so that the comparison reaches the scan.
        of = int if rule.value.lstrip("+-").isdigit() else Decimal if kind.startswith("decimal") else float
        found = compare(column, F.lit(of(rule.value))) if number else F.lit(False)
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        found = compare(column, F.lit(rule.value).try_cast(kind))
    elif kind == "binary":
        found = compare(F.conv(F.hex(column), 16, 10).try_cast("decimal(20,0)"), F.lit(rule.value).try_cast("decimal(20,0)"))
    elif number:
        found = compare(column.try_cast("decimal(38,10)"), F.lit(rule.value).cast("decimal(38,10)"))
    else:
        found = compare(column, F.lit(rule.value))
    return F.coalesce(found, F.lit(False))


def keep_rows(df: DataFrame, rules: str | list[Exclusion]) -> DataFrame:
    """Rows that no rule excludes."""
    for rule in Exclusion.parse(rules) if isinstance(rules, str) else rules:
        df = df.where(~excluded(df, rule))
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns: the exact name first, else the name in any case."""
    exact = {k: v for k, v in names.items() if k in df.columns}
    lower = {k.lower(): v for k, v in names.items() if k not in df.columns}
    return df.withColumnsRenamed(exact | {c: lower[c.lower()] for c in df.columns if c not in exact and c.lower() in lower})


def chained(df: DataFrame, steps: list[tuple[int, str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, dict[str, Observation]]:
    """Filters one after another by ascending priority, and for each an observation of the rows that it passed on.

    A filter that can't be applied to these columns passes all rows on, and has no observation.
    """
    told = {}
    for _, name, step in sorted(steps, key=lambda s: s[0]):
        try:
            out = step(df)
            out.schema  # noqa: B018  # analysed here, so that a filter that doesn't fit is found before the job
        except AnalysisException:
            continue
        told[name] = Observation(name)
        df = out.observe(told[name], F.count("*").alias("passed"))
    return df, told


def configured_filters(settings: dict[str, str], known: dict[str, Callable]) -> list[tuple[int, str, Callable[[DataFrame], DataFrame]]]:
    """Steps for ``chained`` from settings: ``filters`` lists names, ``filter.<name>.class`` what each is of ``known``, the rest its properties.

    ``known`` are functions of a frame and named properties; a property takes the type of its annotation (str, int, float, bool,
    list). ``filter.<name>.priority`` orders the filters, 100 where none is given. A name without a known class, a property
    that the function hasn't, or a value that isn't of its type is an error: a filter that is left out would let rows through.
    """
    steps = []
    of_type = {"int": int, "float": float, "bool": lambda v: {"true": True, "false": False}[v.lower()], "list": lambda v: [x.strip() for x in v.split(",") if x.strip()], "str": str}
    for name in filter(None, (n.strip() for n in settings.get("filters", "").split(","))):
        own = {k.removeprefix(f"filter.{name}."): v.strip() for k, v in settings.items() if k.startswith(f"filter.{name}.")}
        kind, priority = own.pop("class", ""), int(own.pop("priority", "100"))
        if kind not in known:
            raise ValueError(f"filter {name}: no class {kind!r}")
        kinds = {k: p.annotation if isinstance(p.annotation, str) else getattr(p.annotation, "__name__", "str") for k, p in list(inspect.signature(known[kind]).parameters.items())[1:]}
        if unknown := own.keys() - kinds.keys():
            raise ValueError(f"filter {name}: no property {sorted(unknown)}")
        try:
            values = {k: of_type.get(kinds[k].split("[")[0], str)(v) for k, v in own.items()}
        except (KeyError, ValueError) as error:
            raise ValueError(f"filter {name}: not of its type: {error}") from None
        steps.append((priority, name, functools.partial(_with, known[kind], values)))
    return steps


def _with(step: Callable, values: dict, df: DataFrame) -> DataFrame:
    return step(df, **values)


def add_constants(df: DataFrame, extras: dict[str, str], created: str | None = None, updated: str | None = None) -> DataFrame:
    """Constant columns, and the load time under the names asked for."""
    times = {c: F.current_timestamp() for c in (created, updated) if c}
    return df.withColumns({k: F.lit(v) for k, v in extras.items()} | times)


def wildcard(pattern: str) -> str:
    """``*`` and ``?``, or ``regex:...``, as an anchored regular expression."""
    if pattern.startswith("regex:"):
        return f"^(?:{pattern[6:]})$"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def in_scope(name: Column, do: list[str], ignore: list[str]) -> Column:
    """Whether a ``db.table`` is in scope, in any case; what is ignored wins, and a null name passes."""
    match = lambda patterns: F.lit(False) if not patterns else F.lower(name).rlike("|".join(wildcard(p.lower()) for p in patterns))
    wanted = match(do) if do else F.lit(True)
    return name.isNull() | (wanted & ~match(ignore))


def event_wanted(kind: Column, skip: list[str], allow: list[str]) -> Column:
    """Events of a kind that is equal to, or contains, an allowed one and none to skip."""
    any_of = lambda words: F.lit(False) if not words else F.coalesce(sum((kind.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return ~any_of(skip) & (any_of(allow) if allow else F.lit(True))


def changed_only(before: Column, after: Column) -> Column:
    """Entries of the ``after`` map that differ from ``before``."""
    return F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.element_at(before, k)))


def changed_case(name: Column, to: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "none": lambda c: c}[to](name)
