"""What came before each row of its key, found by ranges of the order, so that a hot key is many groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that one group spans.
WIDTH = 100_000


def before(df: DataFrame, keys: list[str], order: str, measures: dict[str, tuple[str, Column]], width: int = WIDTH) -> DataFrame:
    """Adds for each of ``measures`` (name to "max" or "sum" and a value) that of all earlier rows of the key; null where there is none.

    ``order`` is a whole number; rows without it stand in front. The rows that share one value of it see some of each
    other, in no stated order. Null keys are a key. A range's total is a partial aggregate, and what is ordered by key
    alone is a row a range; it enters the next range as a row in front, so that rows are shuffled once, by key and range.
    ``df`` is read twice.
    """
    kinds = {name: {"max": F.max, "sum": F.sum}[how] for name, (how, _) in measures.items()}
    part = F.coalesce(F.floor(F.col(order) / width).cast("bigint"), F.lit(-(2**62)))
    x = df.withColumns({"_part": part, "_row": F.lit(1), **{f"_v_{name}": value for name, (_, value) in measures.items()}})
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "_part").agg(*[of(f"_v_{name}").alias(f"_v_{name}") for name, of in kinds.items()])
    carried = totals.select(*keys, "_part", F.lit(0).alias("_row"), *[of(f"_v_{name}").over(ahead).alias(f"_v_{name}") for name, of in kinds.items()])
    within = Window.partitionBy(*keys, "_part").orderBy("_row", order).rowsBetween(Window.unboundedPreceding, -1)
    found = x.unionByName(carried, allowMissingColumns=True).withColumns({name: of(f"_v_{name}").over(within) for name, of in kinds.items()})
    return found.where("_row = 1").select(*df.columns, *measures)
