"""Conflicting writes from several nodes, and the order in which changes may be applied."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .components import components, contracted
from .folds import ordered_fold
from .scans import WIDTH, before


def last_write_wins(log: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each key: the newest source time, then the larger node, then the larger seqno.

    Events without a key or a time are applied as they come and recorded nowhere: they are all in the result.
    """
    rest = [c for c in log.columns if c not in keys]
    known = F.col("source_ts").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    won = log.where(known).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("source_ts", "node", "seqno")).alias("_row")).select(*keys, "_row.*")
    return won.unionByName(log.where(~known))


def _known(keys: list[str]) -> Column:
    """Whether an event has a key and a time to be judged by."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in ("source_ts", *keys)])


def with_record(log: DataFrame, keys: list[str], policy: str, width: int = WIDTH) -> DataFrame:
    """Adds held_ts and held_node: what is recorded of the key when the event comes, null where nothing is.

    By ``lww`` that is the greatest (time, node) so far; by ``error`` the first event of the latest time so far, as no
    other of that time is let in. Events without a key or a time have no record and leave none. A hot key is cut into
    ranges of ``width`` of seqno.
    """
    rank = F.struct("source_ts", "node") if policy == "lww" else F.struct("source_ts", -F.col("seqno"), "node")
    x = before(log.where(_known(keys)), keys, "seqno", {"_held": ("max", rank)}, width)
    x = x.select(*log.columns, F.col("_held.source_ts").alias("held_ts"), F.col("_held.node").alias("held_node"))
    return x.unionByName(log.where(~_known(keys)), allowMissingColumns=True)


def decide(log: DataFrame, keys: list[str], policy: str, primary: str | None = None, width: int = WIDTH) -> DataFrame:
    """Adds decision (APPLY, SKIP or ERROR) to every event, in order of seqno for each key.

    A newer event applies; of one node an equally old one too; of another node an older or equal one is a conflict:
    by ``lww`` the larger node wins a tie, by ``node_priority`` the primary wins, by ``error`` it is an error. Events
    without a key or a time apply and are not remembered.
    """
    if policy in ("lww", "error"):
        newer = F.col("held_ts").isNull() | (F.col("source_ts") > F.col("held_ts"))
        tie = (F.col("source_ts") == F.col("held_ts")) & ((F.col("node") >= F.col("held_node")) if policy == "lww" else (F.col("node") == F.col("held_node")))
        lost = F.lit("SKIP") if policy == "lww" else F.when(F.col("node") == F.col("held_node"), "SKIP").otherwise("ERROR")
        return with_record(log, keys, policy, width).withColumn("decision", F.when(newer | tie, F.lit("APPLY")).otherwise(lost)).drop("held_ts", "held_node")
    if policy != "node_priority":
        raise ValueError(f"no policy: {policy}")
    judged = _by_priority(log.where(_known(keys)), keys, primary, width)
    return judged.unionByName(log.where(~_known(keys)).withColumn("decision", F.lit("APPLY")))


def _effect(primary: str | None, kind: str) -> Callable[[Column], Column]:
    """What a range's events, (seqno, source_ts, node) in order, make of any record that was held before them.

    ``has``: whether one is of the primary. If so, and the primary held the record at a time not before ``cm``, it then
    holds it at the later of that and ``ct``; whatever else was held, at ``ct``: two such steps make one of that form.
    ``top`` is the first of the latest events of other nodes since; it takes over if it is later than what is held.
    """
    whole = f"struct<has:boolean,cm:{kind},ct:{kind},top:struct<ts:{kind},seq:bigint,node:string>>"

    def step(acc: Column, e: Column) -> Column:
        m = acc["top"]["ts"]
        keeps = m.isNull() | (acc["ct"] >= m)
        cm = F.when(~acc["has"], m).when(keeps, acc["cm"]).otherwise(F.greatest(acc["cm"], m))
        ct = F.when(~acc["has"] | ~keeps, e["source_ts"]).otherwise(F.greatest(acc["ct"], e["source_ts"]))
        top = F.greatest(acc["top"], F.struct(e["source_ts"].alias("ts"), (-e["seqno"]).cast("bigint").alias("seq"), e["node"].alias("node")))
        taken = F.struct(F.lit(True).alias("has"), cm.alias("cm"), ct.alias("ct"), F.lit(None).cast(f"struct<ts:{kind},seq:bigint,node:string>").alias("top"))
        return F.when(F.coalesce(e["node"] == F.lit(primary), F.lit(False)), taken).otherwise(F.struct(acc["has"].alias("has"), acc["cm"].alias("cm"), acc["ct"].alias("ct"), top.alias("top"))).cast(whole)

    none = F.lit(None)
    return lambda events: F.aggregate(events, F.struct(F.lit(False).alias("has"), none.alias("cm"), none.alias("ct"), none.alias("top")).cast(whole), step)


def _by_priority(log: DataFrame, keys: list[str], primary: str | None, width: int) -> DataFrame:
    """Adds decision: the primary takes a record from any other node, and loses it to later events.

    Each range of ``width`` of seqno becomes its effect on a record, a key's effects are followed in order, one row a
    range, and the record that enters a range goes in front of its events: a hot key is judged in many tasks.
    """
    kind = log.schema["source_ts"].dataType.simpleString()
    x = log.withColumns({"_part": F.floor(F.col("seqno") / width).cast("bigint"), "_row": F.lit(1)})
    effects = x.groupBy(*keys, "_part").agg(_effect(primary, kind)(F.array_sort(F.collect_list(F.struct("seqno", "source_ts", "node")))).alias("_e"))
    effects = effects.select(*keys, "_part", "_e.has", "_e.cm", "_e.ct", F.col("_e.top.ts").alias("mt"), F.col("_e.top.node").alias("mn"))

    def follow(state, row):
        held = state
        if row["has"]:
            kept = held is not None and held[1] == primary and (row["cm"] is None or held[0] >= row["cm"])
            held = (max(held[0], row["ct"]) if kept else row["ct"], primary)
        if row["mt"] is not None and (held is None or row["mt"] > held[0]):
            held = (row["mt"], row["mn"])
        return held, state or (None, None)

    def step(state, row):
        ts, node = row["source_ts"], row["node"]
        if row["_row"] == 0:
            return (ts, node), (None,)
        wins = state is None or ts > state[0] or (ts == state[0] if node == state[1] else node is not None and node == primary)
        return ((ts, node), ("APPLY",)) if wins else (state, ("SKIP",))

    held = ordered_fold(effects, keys, ["_part"], follow, None, {"source_ts": kind, "node": "string"}, ["has", "cm", "ct", "mt", "mn"]).where("source_ts IS NOT NULL")
    x = x.unionByName(held.select(*keys, "_part", F.lit(0).alias("_row"), "source_ts", "node"), allowMissingColumns=True)
    judged = ordered_fold(x, [*keys, "_part"], ["_row", "seqno"], step, None, {"decision": "string"}, ["_row", "source_ts", "node"])
    return judged.where("_row = 1").select(*log.columns, "decision")


def conflict_log(log: DataFrame, keys: list[str], policy: str = "lww") -> DataFrame:
    """Events that met another node's record as new as they are or newer: who came, what was held and who won."""
    x = with_record(log, keys, policy).where((F.col("node") != F.col("held_node")) & (F.col("source_ts") <= F.col("held_ts")))
    wins = (F.col("source_ts") == F.col("held_ts")) & (F.col("node") > F.col("held_node")) if policy == "lww" else F.lit(False)
    winner = F.when(wins, "INCOMING").otherwise("STORED")
    return x.select(*keys, "seqno", F.col("node").alias("incoming_node"), F.col("source_ts").alias("incoming_ts"), F.col("held_node").alias("stored_node"), F.col("held_ts").alias("stored_ts"), F.lit(policy).alias("policy"), winner.alias("winner"))


def before_image_check(log: DataFrame, target: DataFrame, keys: list[str], before: str, held: str) -> DataFrame:
    """Adds decision: APPLY where the row is as the change saw it, else by source time and then node."""
    x = log.join(target, keys, "left")
    same = F.col(before).eqNullSafe(F.col(held))
    newer = F.col("held_ts").isNull() | (F.col("source_ts") > F.col("held_ts")) | ((F.col("source_ts") == F.col("held_ts")) & (F.col("node") >= F.coalesce("held_node", F.lit(""))))
    return x.withColumn("decision", F.when(same | newer, F.lit("APPLY")).otherwise(F.lit("SKIP")))


def conflict_keys(log: DataFrame, batch: str, table: str, pk: str) -> DataFrame:
    """Adds conflict_key: a row's, or its table's in batches where any event of the table has no key."""
    lacking = log.where(F.col(pk).isNull()).select(batch, table).distinct().withColumn("_whole", F.lit(True))
    x = log.join(lacking, [batch, table], "left")
    key = F.when(F.col("_whole"), F.concat(F.lit("T|"), table)).otherwise(F.concat(F.lit("R|"), table, F.lit("|"), F.col(pk).cast("string")))
    return x.withColumn("conflict_key", key).drop("_whole")


def conflict_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): groups of nodes that share edges; a node that meets only itself is a group of its own.

    Edges are contracted within ranges of the nodes first, so that groups whose numbers lie together take no round.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    found = components(contracted(edges))
    alone = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("root", F.col("node")))


def dependency_layers(log: DataFrame, batch: str, key: str, barrier: str, width: int = WIDTH) -> DataFrame:
    """Adds layer: statements of one layer may run at once.

    Barriers cut a batch into segments. Within one, a statement stands one layer after the last of its key, those
    without key in the first; a barrier stands alone, after all before it. Segments, places and layers are counted by
    ranges of ``width`` of seqno, so that a log that is one batch, or one key, is many groups.
    """
    x = before(log, [batch], "seqno", {"_segment": ("sum", F.col(barrier).cast("long"))}, width).na.fill(0, ["_segment"])
    # What stands in the first layer of its segment counts for nobody: its key is null here, as is a barrier's.
    x = x.withColumn("_key", F.when(~F.col(barrier) & F.col(key).isNotNull(), F.struct(key)))
    x = before(x, [batch, "_segment", "_key"], "seqno", {"_depth": ("sum", F.when(F.col("_key").isNotNull(), 1).otherwise(0).cast("long"))}, width)
    x = x.withColumn("_depth", F.coalesce("_depth", F.lit(0)) + 1)
    deep = x.groupBy(batch, "_segment").agg(F.coalesce(F.max(F.when(~F.col(barrier), F.col("_depth"))), F.lit(0)).alias("_deep"))
    deep = before(deep, [batch], "_segment", {"_base": ("sum", F.col("_deep") + 1)}, width).na.fill(0, ["_base"])
    same = [x[c].eqNullSafe(deep[c]) for c in (batch, "_segment")]
    x = x.join(deep, same, "left").drop(deep[batch], deep["_segment"])
    layer = F.when(F.col(barrier), F.col("_base") + F.col("_deep")).otherwise(F.col("_base") + F.col("_depth") - 1)
    return x.withColumn("layer", layer).drop("_segment", "_depth", "_deep", "_base", "_key")
