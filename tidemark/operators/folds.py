"""Folds whose state depends on what was accepted before, in order, for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .schema_log import WIDTH, as_of


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, start: object, out: dict[str, str], reads: list[str]) -> DataFrame:
    """Adds the columns ``out`` (name to type) that ``step(state, row) -> (state, values)`` gives, in order for each key.

    Rows of a key meet in one partition, sorted, and stream past the fold: what is held is one state, however many
    rows a key has. Only folds that have no associative form should come here; ``reads`` are the columns that a step
    looks at. Values keep their types: a null is None, and whole numbers of any size are exact.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{k}` {v}" for k, v in out.items()])
    kinds = {k: to_arrow_type(_parse_datatype_string(v)) for k, v in out.items()}
    seen = list(dict.fromkeys([*keys, *reads]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for batch in batches:
            added = []
            for values in zip(*(batch.column(c).to_pylist() for c in seen), strict=True):
                row = dict(zip(seen, values, strict=True))
                if (now := tuple(row[k] for k in keys)) != key:
                    key, state = now, start
                state, said = step(state, row)
                added.append(said)
            extra = [pa.array([a[i] for a in added], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *kinds])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(rows, schema)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's key differs from that of the row before; nulls are equal."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        x, y = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        differ = pc.if_else(pc.and_(x.is_null(), y.is_null()), False, pc.fill_null(pc.not_equal(x, y), True))
        out |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


def run_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, out: tuple[str, str], reads: str) -> DataFrame:
    """Like ``ordered_fold``, for folds over arrays: ``step(state, values) -> (state, array)`` takes the part of a key in a batch at once.

    ``values`` is a masked array of the column ``reads``; a key's first state is None.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out[0]}` {out[1]}"])
    kind = to_arrow_type(_parse_datatype_string(out[1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(reads)
            values = np.ma.masked_array(pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False))
            cuts, parts = [0, *_changes(batch, keys).tolist(), batch.num_rows], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := tuple(batch.column(k)[a].as_py() for k in keys)) != key:
                    key, state = now, None
                state, part = step(state, values[a:b])
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), kind)], [*batch.schema.names, out[0]])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(rows, schema)


def cooldown(df: DataFrame, keys: list[str], at: str, ties: list[str], seconds: int = 300) -> DataFrame:
    """Adds fired: whether the row comes at least ``seconds`` after the last one that fired; a row without a time doesn't.

    ``at``: whole seconds; ``ties``: the order of rows of one second. The next row that fires is found by bisection, so that
    Python takes a step a firing, not a row.
    """

    def step(last, times):
        fired, known = np.zeros(len(times), bool), np.flatnonzero(~np.ma.getmaskarray(times))
        sorted_times, i = np.ma.getdata(times)[known], 0
        while i < len(known):
            if last is not None:
                i = max(i, int(np.searchsorted(sorted_times, last + seconds)))
                if i >= len(known):
                    break
            fired[known[i]], last = True, int(sorted_times[i])
            i += 1
        return last, fired

    return run_fold(df, keys, [at, *ties], step, ("fired", "boolean"), at)


def breaker(df: DataFrame, keys: list[str], order: str, at: str, failed: str, most: int = 5, open_ms: int = 1000, factor: float = 2.0, longest_ms: int = 60_000) -> DataFrame:
    """Adds state: what a circuit breaker says when the call comes: CLOSED, HALF_OPEN (the call is a trial) or OPEN (refused).

    ``most`` failures in a row open it for ``open_ms``; after that one trial is let through, which closes it or opens it
    for ``factor`` times as long, ``longest_ms`` at most. A refused call's outcome doesn't count.
    """

    def step(state, row):
        failures, until, wait = state
        if until is not None and row[at] < until:
            return state, ("OPEN",)
        said = "CLOSED" if until is None else "HALF_OPEN"
        if not row[failed]:
            return (0, None, open_ms), (said,)
        if said == "HALF_OPEN":
            wait = min(int(wait * factor), longest_ms)
            return (failures, row[at] + wait, wait), (said,)
        failures += 1
        return (failures, row[at] + wait if failures >= most else None, wait), (said,)

    return ordered_fold(df, keys, [order], step, (0, None, open_ms), {"state": "string"}, [at, failed])


def hysteresis(df: DataFrame, keys: list[str], order: str, level: str, low: float, high: float, width: int = WIDTH) -> DataFrame:
    """Adds state: PAUSED above ``high`` until below ``low``, else RUNNING: whichever threshold was crossed last.

    A null level crosses none. ``order`` is a whole number; the last crossing is found by ranges of ``width`` of it
    (``schema_log.as_of``), so that a hot key is many groups.
    """
    crossed = F.when(F.col(level) > high, "PAUSED").when(F.col(level) < low, "RUNNING")
    crossings = df.select(*keys, order, crossed.alias("state")).where("state IS NOT NULL")
    return as_of(df, crossings, keys, order, "state", width).na.fill("RUNNING", ["state"])
