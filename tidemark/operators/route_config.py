"""Routing rules as configured text, checked as a whole: any mistake is an error, none is passed over."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wildcard
from .routing import SplitRule, split_route

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")
#: What configured words mean.
KINDS = {"HASH_MOD": "hash_mod", "RANGE": "range", "LIST": "list", "DATE_FORMAT": "date_format"}
TAGS = ("_src_node", "_src_db", "_src_table")


@dataclass(frozen=True)
class Merge:
    """Tables that match go into one."""

    match: str
    target: str
    key: str = "COMPOSITE_SOURCE"
    tags: tuple[str, ...] = TAGS
    ddl: str = "FIRST_WINS"


@dataclass(frozen=True)
class Routes:
    mode: str = "NONE"
    merges: tuple[Merge, ...] = ()
    splits: tuple[tuple[str, SplitRule], ...] = ()
    nodes: dict[str, int] = field(default_factory=dict)

    def of(self, table: str) -> Merge | SplitRule | None:
        """The first rule that the ``db.table`` matches; None: it goes as it is."""
        rules = [(m.match, m) for m in self.merges] if self.mode == "MERGE" else list(self.splits)
        return next((rule for pattern, rule in rules if re.match(wildcard(pattern.lower()), table.lower())), None)

    def compare_targets(self, node: str, table: str) -> list[tuple[str, str, str]] | None:
        """(database, table, condition) that hold the rows of a source table; None where they can't be listed."""
        db, _, name = table.partition(".")
        rule = self.of(table)
        if rule is None:
            return [(db, name, "")]
        if isinstance(rule, Merge):
            to_db, _, to = rule.target.rpartition(".")
            said = {"_src_node": node, "_src_db": db, "_src_table": name}
            return [(to_db or db, to, " AND ".join(f"{t} = '{said[t]}'" for t in rule.tags if t in said) if rule.key != "KEEP" else "")]
        if rule.shards is None:
            return None
        return [(_filled(rule.database, i), _filled(rule.table, i), "") for i in range(rule.shards)]


def _filled(template: str, shard: int) -> str:
    step = {"/": lambda n: shard // n, "%": lambda n: shard % n}
    return re.sub(r"\$\{shard(?:([/%])(\d+))?\}", lambda m: str(step[m[1]](int(m[2])) if m[1] else shard), template)


def _rules(settings: dict[str, str], prefix: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for k in sorted(k for k in settings if k.startswith(prefix)):
        number, _, name = k[len(prefix) :].partition(".")
        out.setdefault(number, {})[name] = settings[k].strip()
    return out


def _pairs(text: str) -> list[tuple[str, str]]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, colon, b = part.rpartition(":")
        if not colon or not a.strip() or not b.strip():
            raise ValueError(f"not a pair: {part!r}")
        out.append((a.strip(), b.strip()))
    return out


def _split(said: dict[str, str], nodes: dict[str, int]) -> tuple[str, SplitRule]:
    if not said.get("match") or not said.get("shard.key"):
        raise ValueError("a split needs match and shard.key")
    if (algo := said.get("algo", "HASH_MOD").upper()) not in KINDS:
        raise ValueError(f"no algorithm: {algo}")
    group = said.get("target.group")
    if group and group not in nodes:
        raise ValueError(f"no nodes of group {group}")
    ranges = tuple((int(a), int(b)) for a, b in _pairs(said.get("range", "")))
    if any(a >= b for a, b in ranges) or any(x[1] > y[0] for x, y in zip(sorted(ranges), sorted(ranges)[1:], strict=False)):
        raise ValueError("ranges must go up and not overlap")
    values = tuple((a, int(b)) for a, b in _pairs(said.get("list", "")))
    source = said["match"].rpartition(".")
    rule = SplitRule(
        said["shard.key"], KINDS[algo], int(said.get("count", 0)), ranges, values, said.get("date.format", ""), said.get("target.db", source[0]), said.get("target.table", source[2]),
        nodes.get(group, 1), said.get("target.node", ""), said.get("unrouted", "BROADCAST").lower(),
    )
    if algo == "DATE_FORMAT" and (not rule.pattern or rule.unrouted == "broadcast"):
        raise ValueError("a date split needs date.format, and can't send a row everywhere")
    if rule.shards is not None:
        targets = {(_filled(rule.database, i), _filled(rule.table, i)) for i in range(rule.shards)}
        if len(targets) < rule.shards:
            raise ValueError("shards share a target")
        if bad := [x for t in targets for x in t if x and not _NAME.fullmatch(x)]:
            raise ValueError(f"not a name: {bad[0]!r}")
    return said["match"], rule


def _merge(said: dict[str, str]) -> Merge:
    if not said.get("match") or not said.get("target"):
        raise ValueError("a merge needs match and target")
    out = Merge(said["match"], said["target"], said.get("pk.strategy", "COMPOSITE_SOURCE").upper(), tuple(t.strip() for t in said.get("tag.columns", ",".join(TAGS)).split(",") if t.strip()), said.get("ddl.policy", "FIRST_WINS").upper())
    if out.key not in ("COMPOSITE_SOURCE", "KEEP") or out.ddl not in ("FIRST_WINS", "SKIP", "MANUAL"):
        raise ValueError("pk.strategy or ddl.policy has no such value")
    if bad := [x for x in (*out.target.split("."), *out.tags) if not _NAME.fullmatch(x)]:
        raise ValueError(f"not a name: {bad[0]!r}")
    if out.key == "COMPOSITE_SOURCE" and not out.tags:
        raise ValueError("a composite key needs tag columns")
    return out


def parse_routes(settings: dict[str, str]) -> Routes:
    """``route.mode`` NONE, MERGE or SPLIT, with ``route.merge.<n>.*``, ``route.split.<n>.*`` and ``route.node.<group>.<i>.host``."""
    mode = settings.get("route.mode", "NONE").strip().upper()
    if mode not in ("NONE", "MERGE", "SPLIT"):
        raise ValueError(f"no mode: {mode}")
    if mode == "NONE":
        return Routes()
    hosts = {tuple(k.split(".")[2:4]) for k in settings if re.fullmatch(r"route\.node\.[^.]+\.\d+\.host", k)}
    nodes = {g: sum(x == g for x, _ in hosts) for g, _ in hosts}
    wrong, found = [], []
    for number, said in _rules(settings, f"route.{mode.lower()}.").items():
        try:
            found.append(_merge(said) if mode == "MERGE" else _split(said, nodes))
        except ValueError as e:
            wrong.append(f"rule {number}: {e}")
    if not found and not wrong:
        wrong.append(f"mode {mode} has no rule")
    if wrong:
        raise ValueError("; ".join(wrong))
    return Routes(mode, tuple(found) if mode == "MERGE" else (), tuple(found) if mode == "SPLIT" else (), nodes)


def routed(df: DataFrame, table: str, routes: Routes) -> DataFrame:
    """Rows of a ``db.table`` with target_db and target_table: by its split rule, to its merged table, or as it is."""
    rule = routes.of(table)
    if isinstance(rule, SplitRule):
        return split_route(df, rule)
    db, _, name = table.partition(".")
    to_db, _, to = rule.target.rpartition(".") if rule else (db, "", name)
    return df.withColumns({"target_db": F.lit(to_db or db), "target_table": F.lit(to)})


def tagged_key(pk: list[Column], tags: list[Column], separator: str = "\u0001") -> Column:
    """The key of a row in a merged table: its own key, then where it is from."""
    return F.concat_ws(separator, *[c.cast("string") for c in (*pk, *tags)])
