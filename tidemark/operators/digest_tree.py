"""Trees of digests over key ranges: two tables are compared from the root down, and only rows of unequal ranges are read again.

A row's key has a place below ``fan ** levels``: a whole number, decimal, date or time by its value between the least and
greatest of both tables, a key of any other type or of several columns by its hash. A leaf holds the number of rows of one
place, and of two independent 60-bit parts of their digests the sum and the exclusive or; it is a partial aggregate, so a
task sends a row a place at most. A node's digest is that of its children's in their order. Two trees are joined level by
level below the nodes that differ. What is read again are the rows of the unequal leaves, by ranges of a whole-number
key, so that Parquet's and a database's statistics skip the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written

FAN, LEVELS = 1024, 2
#: Ranges of the key that a second read asks for at most; neighbours are joined until they are that few.
RANGES = 64
#: Unequal leaves that go to all tasks at most (32 bytes each); more are met by a join.
FEW = 100_000
_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def text_of(column: str, kind: str) -> Column:
    """A cell as text that is equal where values are equal, and different where they differ."""
    c = F.col(column)
    if kind == "binary":
        return F.base64(c)
    if kind in ("float", "double"):
        return (c + F.lit(0).cast(kind)).cast("string")  # the shortest text that reads back as the same number; -0 is 0
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind.startswith("map"):
        return F.to_json(F.array_sort(F.map_entries(c)), {"ignoreNullFields": "false"})
    if kind.startswith(("array", "struct")):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """All cells in one text that no other row has: a length before each, and a mark of its own for null."""
    kinds = dict(df.dtypes)
    cells = [text_of(c, kinds[c]) for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in cells])


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    return F.md5(row_text(df, columns))


def parts(digest: Column) -> tuple[Column, Column]:
    """Two independent numbers of 60 bits from a hexadecimal digest."""
    number = lambda begin: F.conv(F.substring(digest, begin, 15), 16, 10).cast("bigint")
    return number(1), number(16)


def totals(digest: Column) -> list[Column]:
    """Aggregates that tell sets of digests apart, repeated rows included: n, sum_a, xor_a, sum_b and xor_b."""
    a, b = parts(digest)
    both = lambda x, name: [F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"sum_{name}"), F.coalesce(F.bit_xor(x), F.lit(0)).alias(f"xor_{name}")]
    return [F.count("*").alias("n"), *both(a, "a"), *both(b, "b")]


def _number(df: DataFrame, column: str) -> Column | None:
    """A column as a double in its own order, None for types that have none here."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind in _NUMBERS or kind.startswith("decimal"):
        return c.cast("double")
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    return None


@dataclass(frozen=True)
class Places:
    """How keys have places; made from both tables, so that equal keys share one."""

    pk: list[str]
    fan: int
    levels: int
    low: float | None = None
    high: float | None = None

    @staticmethod
    def of(tables: list[DataFrame], pk: list[str], fan: int = FAN, levels: int = LEVELS) -> Places:
        numbers = [_number(df, pk[0]) for df in tables]
        if len(pk) > 1 or any(n is None for n in numbers):
            return Places(pk, fan, levels)
        ends = [df.agg(F.min(n), F.max(n)).first() for df, n in zip(tables, numbers, strict=True)]
        lows, highs = [e[0] for e in ends if e[0] is not None], [e[1] for e in ends if e[1] is not None]
        return Places(pk, fan, levels, min(lows, default=0.0), max(highs, default=0.0))

    @property
    def count(self) -> int:
        return self.fan**self.levels

    def place(self, df: DataFrame) -> Column:
        """The place of each row; null keys are at 0."""
        if self.low is None:
            kinds = dict(df.dtypes)
            return F.pmod(F.xxhash64(*[text_of(c, kinds[c]) for c in self.pk]), F.lit(self.count))
        step = (_number(df, self.pk[0]) - F.lit(self.low)) / F.lit(max(self.high - self.low, 1.0)) * F.lit(float(self.count - 1))
        return F.coalesce(F.floor(step).cast("bigint"), F.lit(0).cast("bigint"))

    def between(self, df: DataFrame, ranges: list[tuple[int, int]]) -> Column:
        """A condition on a whole-number key that holds for all places of ``ranges``, to be pushed to the scan; true for other keys."""
        kind = dict(df.dtypes)[self.pk[0]]
        if self.low is None or kind not in _NUMBERS:
            return F.lit(True)
        width, c = max(self.high - self.low, 1.0) / (self.count - 1), F.col(self.pk[0])
        # One place wider at both ends, and by what doubles of this size round away.
        spare = 1 + max(abs(self.low), abs(self.high)) * 2.0**-50
        lowest, most = (-(1 << 63), (1 << 63) - 1)
        fit = lambda v: F.lit(max(lowest, min(most, int(v))))
        conds = [(c >= fit(self.low + (a - 1) * width - spare)) & (c <= fit(self.low + (b + 2) * width + spare)) for a, b in ranges]
        return reduce(lambda x, y: x | y, conds, F.lit(False)) | (c.isNull() if any(a == 0 for a, _ in ranges) else F.lit(False))


def leaves(df: DataFrame, columns: list[str], places: Places) -> DataFrame:
    """(node, rows, digest) of every place that has rows."""
    x = df.select(places.place(df).alias("node"), row_digest(df, columns).alias("d")).groupBy("node").agg(*totals(F.col("d")))
    return x.select("node", F.col("n").alias("rows"), F.md5(F.concat_ws(":", "n", "sum_a", "xor_a", "sum_b", "xor_b")).alias("digest"))


def folded(level: DataFrame, fan: int) -> DataFrame:
    """The level above: a node's digest is that of its children's places and digests in order, ``fan`` at most."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["digest"]))
    return level.groupBy(F.floor(F.col("node") / fan).cast("bigint").alias("above")).agg(F.sum("rows").alias("rows"), F.md5(F.array_join(children, ",")).alias("digest")).withColumnRenamed("above", "node")


def tree(df: DataFrame, columns: list[str], places: Places) -> list[DataFrame]:
    """All levels from the root down; the leaves are written, so that a walk over the tree reads no row of the table."""
    level = written(leaves(df, columns, places))
    out = [level]
    for _ in range(places.levels):
        level = folded(level, places.fan)
        out.append(level)
    return out[::-1]


def checksum(df: DataFrame, columns: list[str], pk: list[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """row_count and checksum of a table: its tree's root. A table without rows has the checksum of no children."""
    root = tree(df, columns, Places.of([df], pk, fan, levels))[0]
    return root.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.coalesce(F.max("digest"), F.md5(F.lit("").cast("binary"))).alias("checksum"))


@dataclass(frozen=True)
class Unequal:
    """What a comparison of two trees found: nodes that differ and rows below them by level, and the rows to be read again."""

    levels: list[tuple[int, int, int]]
    source: DataFrame
    target: DataFrame


def _merged(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges in order, the nearest neighbours joined until there are ``most``."""
    while len(ranges) > most:
        gaps = [b[0] - a[1] for a, b in zip(ranges, ranges[1:], strict=False)]
        cut = sorted(gaps)[len(ranges) - most - 1]
        out = [ranges[0]]
        spare = len(ranges) - most
        for r, gap in zip(ranges[1:], gaps, strict=True):
            if gap <= cut and spare:
                out[-1], spare = (out[-1][0], r[1]), spare - 1
            else:
                out.append(r)
        ranges = out
    return ranges


def unequal(source: DataFrame, target: DataFrame, columns: list[str], pk: list[str], fan: int = FAN, levels: int = LEVELS) -> Unequal:
    """Compares two tables from the root of their trees down.

    The driver sees one number of nodes and rows a level, and the unequal ranges of the first level (``fan`` rows at most).
    """
    places = Places.of([source, target], pk, fan, levels)
    trees = [tree(df, columns, places) for df in (source, target)]
    bad, found, ranges = None, [], []
    for depth in range(levels + 1):
        s, t = (x[depth].withColumnsRenamed({"rows": f"rows_{side}", "digest": f"digest_{side}"}) for x, side in zip(trees, "st", strict=True))
        if bad is not None:
            above = bad.select(F.col("node").alias("above"))
            s, t = (x.join(above, F.floor(x["node"] / fan) == above["above"], "left_semi") for x in (s, t))
        both = s.join(t, "node", "full_outer").where(~F.col("digest_s").eqNullSafe(F.col("digest_t")))
        bad = written(both.select("node", (F.coalesce("rows_s", F.lit(0)) + F.coalesce("rows_t", F.lit(0))).alias("rows")))
        n, rows = bad.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        found.append((depth, n, rows))
        if not n:
            break
    if found[-1][1] and len(found) == levels + 1:
        # The least and greatest unequal leaf of each unequal node below the root.
        first = F.floor(F.col("node") / fan ** (levels - 1))
        ranges = _merged(sorted((r.a, r.b) for r in bad.groupBy(first).agg(F.min("node").alias("a"), F.max("node").alias("b")).collect()), RANGES)
        few = F.broadcast(bad.select("node")) if found[-1][1] <= FEW else bad.select("node")
        again = [df.where(places.between(df, ranges)).withColumn("_place", places.place(df)).join(few, F.col("_place") == few["node"], "left_semi").drop("_place") for df in (source, target)]
    else:
        again = [df.where(F.lit(False)) for df in (source, target)]
    return Unequal(found, *again)
