"""Sharding by balanced label propagation.

Documents start in a shard by a hash. In each round, linked documents learn from joins which
shard most of their neighbours are in and may ask to move there: in odd rounds documents of the
least id among their neighbours, in even rounds the others (half of those with several neighbours,
drawn by a hash), so that neighbours do not swap places for ever. The driver grants flows between shards: what two shards exchange, and what room a shard has.
Grants are thresholds on hash bins, so the driver holds shards x shards x BINS sums, never rows.
Last, shards over their share give away bins of documents, unlinked ones first, to shards under it.

Law `bytes`: sizes are near equal; ties go to the smaller shard number. Defined results: a null
text has size 1; equal rows (doc_id and text) move as one and get a slot each; an empty table gives
an empty table; a null doc_id is an id like any other; other columns stay behind.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialize

SHARDS = 16
ROUNDS = 6
BINS = 128
FINE_BINS = 2048
SLACK = 0.02
BROADCAST_HUBS = 300_000
SALT = 16
_COLUMNS = ("id", "size", "linked", "shard", "least", "degree")


def _bin(salt: int, bins: int, *columns: str):
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(bins)).cast("int")


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes: id, size; links: src, dst (ids, any order, at most one row per pair). id, size, linked, shard."""
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst")
    both = materialize(both, "links", shrink=8)
    tied = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("first"), F.count(F.lit(1)).alias("degree"))
    start = nodes.join(tied, "id", "left").select("id", "size", F.col("degree").isNotNull().alias("linked"), _bin(0, shards, "id").alias("shard"), (F.col("first") > F.col("id")).alias("least"), "degree")
    start = materialize(start, "nodes", shrink=8)
    loads = {r["shard"]: r["s"] for r in start.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    total = sum(loads.values())
    # Only linked nodes can want to move, so only they go through the rounds.
    moving = start.filter("linked")
    idle = 0
    for turn in range(1, rounds + 1):
        moving, moved = _round(moving, both, shards, turn, loads, total)
        idle = 0 if moved else idle + 1
        if idle == 2:  # neither kind of document moves any more
            break
    loose = start.filter("not linked")
    return _level(loose.unionByName(moving).select("id", "size", "linked", "shard"), shards)


def _round(moving: DataFrame, both: DataFrame, shards: int, turn: int, loads: dict, total: int):
    label = moving.select(F.col("id").alias("dst"), "shard")
    votes = both.join(label, "dst").groupBy("src", "shard").agg(F.count(F.lit(1)).alias("w"))
    best = votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("shard")).alias("minus"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("shard", "w"))).alias("all"))
    best = best.select(F.col("src").alias("id"), (-F.col("b.minus")).alias("to"), F.col("b.w").alias("w"), "all")
    now = moving.join(best, "id", "left")
    gain = F.col("w") - F.coalesce(F.element_at("all", F.col("shard")), F.lit(0))
    free = F.col("least") if turn % 2 else ~F.col("least") & ((F.col("degree") == 1) | (_bin(1000 + turn, 2, "id") == 0))
    asks = (F.col("to") != F.col("shard")) & (gain > 0) & free
    now = now.select(*_COLUMNS, F.when(asks, F.col("to")).otherwise(F.col("shard")).alias("to"), _bin(turn, BINS, "id").alias("bin"))
    now = materialize(now, f"round{turn}", shrink=8)
    asked = now.filter("to != shard").groupBy("shard", "to", "bin").agg(F.sum("size").alias("s")).collect()
    if not asked:
        return now.select(*_COLUMNS), False
    demand: dict = defaultdict(int)
    for r in asked:
        demand[r["shard"], r["to"]] += r["s"]
    share = total / shards
    # Exchanged flows are free; beyond them a shard takes what room it has, shared out by demand.
    extra = {k: v - min(v, demand.get(k[::-1], 0)) for k, v in demand.items()}
    into: dict = defaultdict(int)
    for (_, to), v in extra.items():
        into[to] += v
    grant = {}
    for (a, b), v in demand.items():
        room = max(0.0, share * (1 + SLACK) - loads.get(b, 0))
        grant[a, b] = v - extra[a, b] + (extra[a, b] * min(1.0, room / into[b]) if into[b] else 0)
    limits, by = [], defaultdict(list)
    for r in asked:
        by[r["shard"], r["to"]].append((r["bin"], r["s"]))
    for (a, b), bins in sorted(by.items()):
        done = 0
        for i, s in sorted(bins):
            if done + s > grant[a, b] and done:
                break
            if s > grant[a, b]:
                continue
            done += s
            limits.append((a, b, i))
        loads[a] = loads.get(a, 0) - done
        loads[b] = loads.get(b, 0) + done
    if not limits:
        return now.select(*_COLUMNS), False
    granted = now.sparkSession.createDataFrame(limits, "shard int, to int, bin int").withColumn("ok", F.lit(True))
    out = now.join(F.broadcast(granted), ["shard", "to", "bin"], "left").select("id", "size", "linked", F.when(F.col("ok"), F.col("to")).otherwise(F.col("shard")).alias("shard"), "least", "degree")
    return out, True


def _level(nodes: DataFrame, shards: int) -> DataFrame:
    """Move bins from shards over their share to shards under it, unlinked nodes first."""
    nodes = materialize(nodes.withColumn("bin", _bin(7, FINE_BINS, "id")), "placed", shrink=8)
    sums = nodes.groupBy("shard", "linked", "bin").agg(F.sum("size").alias("s")).collect()
    load = [0] * shards
    for r in sums:
        load[r["shard"]] += r["s"]
    share = sum(load) / shards
    moves = []
    rows = sorted(sums, key=lambda r: (r["linked"], -r["s"], r["shard"], r["bin"]))
    for passing in (False, True):
        for r in rows:
            if r["linked"] != passing:
                continue
            a, s = r["shard"], r["s"]
            if passing and load[a] <= share * (1 + SLACK / 2):
                continue
            b = min(range(shards), key=lambda i: (load[i], i))
            # A move must bring the two nearer to their share.
            if load[a] - share >= s / 2 and abs(load[a] - s - share) + abs(load[b] + s - share) < abs(load[a] - share) + abs(load[b] - share):
                load[a] -= s
                load[b] += s
                moves.append((a, r["linked"], r["bin"], b))
    if not moves:
        return nodes.select("id", "size", "linked", "shard")
    table = nodes.sparkSession.createDataFrame(moves, "shard int, linked boolean, bin int, target int")
    joined = nodes.join(F.broadcast(table), ["shard", "linked", "bin"], "left")
    return joined.select("id", "size", "linked", F.coalesce("target", "shard").alias("shard"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: documents of equal text are linked."""
    base = keyed(docs).select("doc_id", "k1", "k2", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    base = materialize(base.withColumn("id", F.xxhash64("k1", "k2")), "sizes")
    nodes = base.groupBy("id").agg(F.sum("size").alias("size"))
    links = equal_texts(base)
    placed = propagate(nodes, links, shards, rounds)
    return slots(base.join(placed.select("id", "shard"), "id")).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def equal_texts(base: DataFrame) -> DataFrame:
    """src, dst: a star per text, each document linked with the one of least id; no pairs within a group."""
    same = ["k2", "crc", "size"]
    hubs = base.groupBy(*same).agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub != last")
    hubs = materialize(hubs.select(*same, "hub"), "hubs", shrink=8)
    # Hubs are one row a text. Few are broadcast, so that copies stay where they are; more are repeated for each salt, so that a hot text's copies are dealt out.
    if hubs.count() <= BROADCAST_HUBS:
        met = base.join(F.broadcast(hubs), same)
    else:
        met = base.withColumn("salt", _bin(23, SALT, "id")).join(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*same, "salt"])
    return met.select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct().filter("src != dst")


def cut_edges(links: DataFrame, placed: DataFrame) -> DataFrame:
    """links, cut (links between two shards), cut_by_hash (the same with every document in the shard of its hash, as at the start)."""
    shards = placed.agg((F.max("shard") + 1).alias("n")).first()["n"] or 1
    ends = [placed.select(F.col("id").alias(e), F.col("shard").alias(f"{e}_shard")) for e in ("src", "dst")]
    both = links.join(ends[0], "src").join(ends[1], "dst")
    return both.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("src_shard") != F.col("dst_shard")).alias("cut"), F.count_if(_bin(0, shards, "src") != _bin(0, shards, "dst")).alias("cut_by_hash"))


def slots(rows: DataFrame) -> DataFrame:
    """rows with slot: gapless from 0 in each shard. Numbers come from bins, so no shard is sorted as one."""
    rows = materialize(rows, "shards", shrink=8)
    bins = max(1, rows.count() // 200_000)
    rows = rows.withColumn("part", _bin(11, bins, "id"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k1", "k2"))
    return rows.withColumn("n", number).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("n") - 1 + F.col("before")).cast("long"))
