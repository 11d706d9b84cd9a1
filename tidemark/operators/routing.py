"""Routing rows to targets: one table split over shards, or many tables merged into one."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_hash(key: Column) -> Column:
    """Whole numbers, also as decimals or text, are their own hash, of more than 64 bits the lowest 64; else the crc32 of the text.

    Numbers may have 38 digits.
    """
    text = key.cast("string")
    number, wide = text.try_cast("decimal(38,10)"), F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("decimal(38,0)"))
    whole = F.when(number == F.floor(number), number.cast("decimal(38,0)")).otherwise(wide)
    bits, half = (F.lit(Decimal(n)).cast("decimal(38,0)") for n in (1 << 64, 1 << 63))
    low = F.pmod(whole, bits)
    lowest = F.when(low >= half, low - bits).otherwise(low).try_cast("bigint")
    return F.when(whole.isNotNull(), F.coalesce(whole.try_cast("bigint"), lowest)).otherwise(F.crc32(text.cast("binary")))


def fill(template: str, shard: Column, text: Column | None = None) -> Column:
    """``${shard}``, ``${shard/n}`` and ``${shard%n}`` filled in; a textual shard fills ``${shard}`` alone."""
    out = []
    for literal, op, n in _tokens(template):
        if literal is not None:
            out.append(F.lit(literal))
        elif op == "/":
            out.append(F.floor(shard / int(n)).cast("string"))
        elif op == "%":
            out.append((shard % int(n)).cast("string"))
        else:
            out.append(text if text is not None else shard.cast("string"))
    return F.concat(*out) if out else F.lit("")


def _tokens(template: str):
    at = 0
    for m in re.finditer(r"\$\{shard(?:([/%])(\d+))?\}", template):
        if m.start() > at:
            yield template[at : m.start()], None, None
        yield None, m[1], m[2]
        at = m.end()
    if at < len(template):
        yield template[at:], None, None


@dataclass(frozen=True)
class SplitRule:
    """How a column says the shard: hash_mod, range, list or date_format; and what the shards are called."""

    column: str
    kind: str
    count: int = 0
    ranges: tuple[tuple[int, int], ...] = ()
    values: tuple[tuple[str, int], ...] = ()
    pattern: str = ""
    database: str = "dw"
    table: str = "t_${shard}"
    nodes: int = 1
    node: str = ""
    unrouted: str = "broadcast"
    names: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in ("hash_mod", "range", "list", "date_format"):
            raise ValueError(f"no kind of split: {self.kind}")
        if self.unrouted not in ("broadcast", "deadletter", "error"):
            raise ValueError(f"nothing to do with unrouted rows: {self.unrouted}")
        if self.shards is not None and self.shards < 1:
            raise ValueError("a split needs shards")
        if "${shard" not in self.table + self.database:
            raise ValueError("targets must differ by shard")

    @property
    def shards(self) -> int | None:
        """How many there are; a date split has no end."""
        return {"hash_mod": self.count, "range": len(self.ranges), "list": 1 + max((i for _, i in self.values), default=-1)}.get(self.kind)

    def shard(self, key: Column) -> Column:
        if self.kind == "hash_mod":
            return F.pmod(shard_hash(key), F.lit(self.count)).cast("int")
        if self.kind == "range":
            number = key.cast("string").try_cast("decimal(38,10)")
            return reduce(lambda out, r: F.when((number >= r[1][0]) & (number < r[1][1]), F.lit(r[0])).otherwise(out), reversed(list(enumerate(self.ranges))), F.lit(None).cast("int"))
        if self.kind == "list":
            text, exact, lower = key.cast("string"), dict(self.values), {}
            for k, i in self.values:
                lower.setdefault(k.lower(), i)
            of = lambda m, by: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), by)
            return F.coalesce(of(exact, text), of(lower, F.lower(text)))
        return F.lit(None).cast("int")

    def date_text(self, key: Column) -> Column:
        text = F.regexp_replace(key.cast("string"), "T", " ")
        return F.date_format(F.coalesce(F.try_to_timestamp(text), text.try_cast("timestamp")), self.pattern)


def split_route(df: DataFrame, rule: SplitRule) -> DataFrame:
    """Adds shard, target_db, target_table and target_node; rows without a shard go everywhere, nowhere, or fail."""
    key = df[rule.column]
    if rule.kind == "date_format":
        text = rule.date_text(key)
        out = df.withColumn("shard", F.lit(None).cast("int")).withColumn("_text", text)
        if rule.unrouted == "error":
            out = out.withColumn("_text", F.coalesce("_text", F.raise_error(F.lit("no shard for a row")).cast("string")))
        # A split without end can't be enumerated: unrouted rows go nowhere.
        out = out.withColumn("target_db", fill(rule.database, F.lit(0), F.col("_text"))).withColumn("target_table", fill(rule.table, F.lit(0), F.col("_text")))
        return out.withColumn("target_node", F.when(F.col("_text").isNotNull(), 0)).drop("_text")
    out = df.withColumn("shard", rule.shard(key))
    if rule.unrouted == "broadcast":
        every = F.sequence(F.lit(0), F.lit(rule.shards - 1))
        out = out.withColumn("shard", F.explode(F.when(F.col("shard").isNull(), every).otherwise(F.array("shard"))))
    elif rule.unrouted == "error":
        out = out.withColumn("shard", F.coalesce("shard", F.raise_error(F.lit("no shard for a row")).cast("int")))
    shard = F.col("shard")
    node = (fill(rule.node, shard).cast("int") % rule.nodes) if rule.node else F.least(F.lit(rule.nodes - 1), F.floor(shard * rule.nodes / rule.shards).cast("int"))
    return out.withColumn("target_db", fill(rule.database, shard)).withColumn("target_table", fill(rule.table, shard)).withColumn("target_node", node.cast("int"))


def route_hits(routed: DataFrame) -> DataFrame:
    """Rows of each target; unrouted rows stand under a null target."""
    return routed.groupBy("target_db", "target_table").agg(F.count("*").alias("rows"))


def route_skew(hits: DataFrame, factor: int = 2) -> DataFrame:
    """Share of each target, and whether the largest exceeds ``factor`` times the mean of several."""
    every = Window.partitionBy()
    total, most, n = F.sum("rows").over(every), F.max("rows").over(every), F.count("*").over(every)
    return hits.withColumn("share", F.round(100 * F.col("rows") / total, 4)).withColumn("skewed", (n > 1) & (most * n > factor * total))


def scan_ranges(df: DataFrame, pk: str, shards: int) -> DataFrame:
    """Bounds and rows of each range (low, high] of a numeric key, as a ranged scan would read them."""
    low, high = df.agg(F.min(pk), F.max(pk)).first()
    if low is None:
        low, high = 0, 0
    span = high - low + 1
    count = max(1, min(shards, span))
    width = -(-span // count)
    part = F.floor((F.col(pk) - low) / width).cast("bigint")
    out = df.where(F.col(pk).isNotNull()).groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    return out.select("part", (F.lit(low - 1) + F.col("part") * width).alias("low"), F.least(F.lit(low - 1) + (F.col("part") + 1) * width, F.lit(high)).alias("high"), "rows")


def merge_tagged(sources: list[tuple[str, str, str, DataFrame]], target_columns: list[str] | None = None) -> DataFrame:
    """Many tables as one, each row tagged with its node, database and table. Columns beyond the target's are an error."""
    if target_columns is not None:
        known = {c.lower() for c in target_columns}
        for node, db, name, df in sources:
            if extra := [c for c in df.columns if c.lower() not in known]:
                raise ValueError(f"{node}.{db}.{name} has columns that the target lacks: {extra}")
    tagged = [df.withColumns({"src_node": F.lit(node), "src_db": F.lit(db), "src_table": F.lit(name)}) for node, db, name, df in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_keep_key(merged: DataFrame, pk: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last writer's. Partial maxima go before the shuffle."""
    rest = [c for c in merged.columns if c not in pk]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return merged.groupBy(*pk).agg(last.alias("_row")).select(*pk, "_row.*")


def cross_shard_moves(updates: DataFrame, rule: SplitRule, before: str, after: str) -> DataFrame:
    """Updates as what each shard has to do: one UPDATE, or DELETE at the old and INSERT at the new shard."""
    old, new = rule.shard(F.col(before)), rule.shard(F.col(after))
    step = lambda op, shard: F.struct(F.lit(op).alias("action"), shard.alias("shard"))
    steps = (
        F.when(old.eqNullSafe(new), F.array(step("UPDATE", new)))
        .when(old.isNull(), F.array(step("INSERT", new))).when(new.isNull(), F.array(step("DELETE", old)))
        .otherwise(F.array(step("DELETE", old), step("INSERT", new)))
    )
    return updates.withColumn("_step", F.explode(steps)).select(*updates.columns, "_step.action", "_step.shard")
