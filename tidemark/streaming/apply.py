"""Change logs as streams: applied to a table batch by batch, decided by keyed state, measured by windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import KeyedTable


def apply_batch(sink: KeyedTable, batch: DataFrame) -> None:
    """Fold a batch into the table. Deletes stay as tombstones, so that a replayed batch changes nothing."""
    rest = [c for c in batch.columns if c not in sink.pk]
    last = batch.groupBy(*sink.pk).agg(F.max_by(F.struct(*rest), "seqno").alias("_row")).select(*sink.pk, "_row.*")
    now = sink.read()
    if now is not None:
        known = now.select(*sink.pk, F.col("seqno").alias("_seqno"))
        last = last.join(known, sink.pk, "left").where("_seqno IS NULL OR seqno > _seqno").drop("_seqno")
    sink.merge(last)


def apply_stream(log: DataFrame, sink: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes; at least once from the source, once in the table."""
    return log.writeStream.foreachBatch(lambda batch, _: apply_batch(sink, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_rows(sink: KeyedTable) -> DataFrame:
    """The table without its tombstones."""
    return sink.read().where("op <> 'd'")


def decide_stream(log: DataFrame, key: str, idle_ms: int | None = None) -> DataFrame:
    """seqno, key and decision of a stream of (key, seqno, node, source_ts): newer applies, of a tie the larger node.

    What a key remembers is the time and node of its last accepted write; keys that are idle for
    ``idle_ms`` are forgotten, which needs a stream that runs on.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seqno")
        said = []
        for ts, node in zip(rows["source_ts"].tolist(), rows["node"].tolist(), strict=True):
            wins = held is None or ts > held[0] or (ts == held[0] and node >= held[1])
            held = (ts, node) if wins else held
            said.append("APPLY" if wins else "SKIP")
        state.update(held)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: name[0], "seqno": rows["seqno"].tolist(), "decision": said})

    kind = log.schema[key].dataType.simpleString()
    return log.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seqno long, decision string", "ts long, node string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def throughput_stream(log: DataFrame, ts: str, window: str) -> DataFrame:
    """Events of each tumbling window of a stream that has a watermark, given out once no more are awaited."""
    return log.groupBy(F.window(ts, window)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "events")


def first_of_each(log: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a stream that has a watermark, without the repeats that an at-least-once source sends."""
    return log.dropDuplicatesWithinWatermark(keys)
