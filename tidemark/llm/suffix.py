"""Removal of long repeated byte strings: anchored windows for large tables, and plain prefix doubling.

doubling_spans() is distributed prefix doubling over every byte position: Spark sorts pairs of ranks
at growing offsets, positions whose pair is unique are dropped, the others are ranked anew, until
ranks stand for `length` bytes. It shuffles some hundred bytes a position in all, so report() uses
spans() instead, which gives the same and ranks far fewer positions. Of every window of `length`
bytes the rightmost least hash of its runs of CORE bytes marks an anchor, and equal windows mark
the same one, so it is enough to rank anchors:

1. Rank anchors by CORE bytes (a shuffle that combines first). Unique ones are dropped.
2. Pair each rank with the rank of the bytes around it, from the first window of `length` bytes
   through the anchor to the last. Where the wider rank occurs again, all these windows repeat.
3. Where a CORE rank has several wider ranks, take one anchor of each and compare every window of
   `length` bytes through it, among anchors of equal CORE rank. Those met twice repeat.

Step 3 holds one CORE rank's distinct surroundings in a task, up to HELD of them; ranks with more
are taken apart by window and counted by a shuffle that combines first. Ranks are 64-bit hashes. In
step 3 windows of equal rank are compared byte for byte (taken apart: by a second hash of 64 bits);
in steps 1 and 2 a chance match takes two hashes, of the core and of the surroundings, to agree.

What a row holds of its anchors and spans is in proportion to its own text.

Defined results: a null text is empty; texts shorter than `length` lose nothing; repeated rows are
documents of their own, so each loses what it shares with the others; other columns stay behind; an
empty table gives an empty table; texts of any length are read whole, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, drop, keyed, materialize, partitions, record_batch, small_batches
from .rolling import kgrams, mix, power, window_minima

LENGTH = 200
CORE = 73
HELD = 50_000
BLOCK = 1 << 20
#: Up to so many keys of rows (16 bytes each) are broadcast, after a count; beyond, texts are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def anchors_of(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, core ranks, wider ranks, and how many windows start before and at the anchor or, cut short by the text's end, later."""
    n, reach = len(data), length - core
    found = []
    # Blocks overlap so far that each anchor is seen whole in the block that owns it.
    for begin in range(0, max(1, n - length + 1), BLOCK):
        low = max(0, begin - reach)
        part = data[low : min(n, begin + BLOCK + length + reach)]
        hashes = mix(kgrams(part, core))
        at = window_minima(hashes, reach + 1)
        wide = kgrams(part, length)
        first = np.maximum(at - reach, 0)
        last = np.minimum(at, len(wide) - 1)
        span = wide[first] * power(length) + wide[last]
        span = mix(span + mix(((at - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)))
        own = (at + low >= begin) & ((at + low < begin + BLOCK) | (begin + BLOCK > n - length))
        found.append(((at + low)[own], hashes[at][own], span[own], (at - first)[own], (last - first + 1)[own]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(docs: DataFrame, length: int, core: int) -> DataFrame:
    """k1, k2, pos, core, wide, back (windows that start before the anchor), wins (windows through it)."""
    schema = "k1 long, k2 long, pos long, core long, wide long, back int, wins int"
    target = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[] for _ in range(7)]
            for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(text, np.uint8)
                if len(data) < length:
                    continue
                pos, ranks, wide, back, wins = anchors_of(data, length, core)
                columns = (np.full(len(pos), k1), np.full(len(pos), k2), pos, ranks.view(np.int64), wide.view(np.int64), back.astype(np.int32), wins.astype(np.int32))
                for own, values in zip(kept, columns, strict=True):
                    own.append(values)
            if kept[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), type=f.type) for x, f in zip(kept, target, strict=True)], schema=target)

    data = keyed(docs).select("k1", "k2", F.encode("text", "UTF-8").alias("data"))
    return data.mapInArrow(run, schema)


def _windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Ranks of all windows of each context; contexts of one length are worked on together."""
    alike: dict[int, list[int]] = {}
    for i, c in enumerate(contexts):
        alike.setdefault(len(c), []).append(i)
    out: list = [None] * len(contexts)
    for n, which in alike.items():
        for at in range(0, len(which), 512):
            some = which[at : at + 512]
            table = np.frombuffer(b"".join([contexts[i] for i in some]), np.uint8).reshape(len(some), n)
            for i, ranks in zip(some, mix(kgrams(table, length)), strict=True):
                out[i] = ranks
    return out


def _alike(texts: bytes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether each window, of `length` bytes from its start in texts, equals another of its group byte for byte."""
    wide = 8 if length % 8 == 0 else 1
    windows = np.ndarray((len(texts) - length + 1,), f"V{length}", texts, strides=(1,))
    order = np.argsort(group, kind="stable")
    pairs = np.flatnonzero(group[order][1:] == group[order][:-1])
    out = np.zeros(len(group), bool)
    differ = []
    for at in range(0, len(pairs), 8192):
        some = pairs[at : at + 8192]
        one, other = order[some], order[some + 1]
        a, b = (windows[starts[x]].view(f"u{wide}").reshape(len(x), -1) for x in (one, other))
        same = (a == b).all(axis=1)
        out[one[same]] = True
        out[other[same]] = True
        differ.append(group[one[~same]])
    # Neighbours of one rank that differ: a clash of hashes. Such groups are settled by their bytes.
    for g in np.unique(np.concatenate(differ)) if differ else ():
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(group == g):
            seen.setdefault(windows[starts[i]].tobytes(), []).append(i)
        for own in seen.values():
            out[own] = len(own) > 1
    return out


def _few(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_KEYS


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted: core, wide, many, k1, k2, pos, back, wins. core, wide, many, back, wins, context: the bytes of all windows through the anchor."""
    by_row = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "wide", "many", "pos", "back", "wins")).alias("at"))
    data = keyed(docs).select("k1", "k2", F.encode("text", "UTF-8").alias("data"))
    keys = wanted.select("k1", "k2").distinct()
    if _few(keys):
        data = data.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    rows = data.join(by_row, ["k1", "k2"]).select("data", F.explode("at").alias("a"))
    begin = F.col("a.pos") - F.col("a.back")
    return rows.select("a.core", "a.wide", "a.many", "a.back", "a.wins", F.substring(F.col("data"), (begin + 1).cast("int"), F.col("a.wins") - 1 + length).alias("context"))


def _together(contexts: DataFrame, length: int) -> DataFrame:
    """core, wide, spans: windows through an anchor that repeat, as byte ranges [from, to, ...] relative to the anchor."""
    schema = "core long, wide long, spans array<int>"
    target = arrow_schema(schema)

    def close(rows: list) -> pa.RecordBatch:
        """All of some cores. Equal windows have equal core, place and rank."""
        ranks = _windows([r[5] for r in rows], length)
        back, wins = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
        owners = np.repeat(np.arange(len(rows)), wins)
        places = np.arange(len(owners)) - np.repeat(np.cumsum(wins) - wins + back, wins)
        cores = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        keys = mix(np.concatenate(ranks) + mix(places.view(np.uint64) + cores[owners]))
        sizes = np.array([len(r[5]) for r in rows], np.int64)
        starts = (np.cumsum(sizes) - sizes)[owners] + places + back[owners]
        twice = _alike(b"".join([r[5] for r in rows]), starts, keys, length) | np.array([r[2] for r in rows], bool)[owners]
        owners, places = owners[twice], places[twice]
        out = {"core": [], "wide": [], "spans": []}
        if len(owners):
            heads = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (places[1:] - places[:-1] > length)]))
            tails = np.append(heads[1:], len(owners)) - 1
            spans: dict[int, list[int]] = {}
            for o, a, b in zip(owners[heads].tolist(), places[heads].tolist(), (places[tails] + length).tolist(), strict=True):
                spans.setdefault(o, []).extend((a, b))
            for o, own in spans.items():
                out["core"].append(rows[o][0])
                out["wide"].append(rows[o][1])
                out["spans"].append(own)
        return record_batch(out, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and rows[-1][:2] == row[:2]:
                    continue  # from a repeated row
                if len(rows) > 4096 and rows[-1][0] != row[0]:
                    yield close(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield close(rows)

    dealt = contexts.repartition(partitions(contexts.sparkSession), "core").sortWithinPartitions("core", "wide")
    return dealt.mapInArrow(run, schema)


def _apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many surroundings: one row per window, counted by a shuffle."""

    def run(batch):
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        out = {"core": [], "wide": [], "many": [], "place": [], "rank": [], "check": []}
        for (core, wide, many, back, wins, text), ranks in zip(rows, _windows([r[5] for r in rows], length), strict=True):
            out["core"] += [core] * wins
            out["wide"] += [wide] * wins
            out["many"] += [many] * wins
            out["place"] += range(-back, wins - back)
            out["rank"] += ranks.view(np.int64).tolist()
            out["check"] += [xxhash.xxh3_64_intdigest(text[i : i + length]) - 2**63 for i in range(wins)]
        return out

    key = ["core", "place", "rank", "check"]
    rows = arrow_map(contexts.dropDuplicates(["core", "wide"]), run, "core long, wide long, many boolean, place int, rank long, check long")
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*key, F.lit(True).alias("again"))
    hit = rows.join(twice, key, "left").filter("many or again")
    return hit.groupBy("core", "wide").agg(F.flatten(F.collect_list(F.array(F.col("place"), F.col("place") + length))).alias("spans"))


def spans(docs: DataFrame, length: int = LENGTH, core: int | None = None, held: int = HELD) -> DataFrame:
    """k1, k2, spans: for each row that loses bytes, [from, to, from, to, ...], which may overlap."""
    core = core or max(1, min(CORE, length * CORE // LENGTH))
    every = anchors(docs, length, core)
    # Written first, so that the join deals both sides anew and can split a rank that very many anchors share.
    cores = materialize(every.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"), "cores", shrink=4)
    again = materialize(every.join(cores, "core"), "anchors")
    drop(cores)
    reps = again.groupBy("core", "wide").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "pos", "back", "wins")).alias("r"))
    reps = materialize(reps.select("core", "wide", (F.col("c") > 1).alias("many"), "r.*"), "surroundings", shrink=2)
    sorts = reps.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    # With one surrounding only, all windows through the anchor repeat. Otherwise windows are compared.
    mixed = reps.join(sorts.filter("n > 1"), "core")
    found = _together(_contexts(docs, mixed.filter(F.col("n") <= held), length), length)
    if mixed.filter(F.col("n") > held).limit(1).count():
        found = found.unionByName(_apart(_contexts(docs, mixed.filter(F.col("n") > held), length), length))
    alike = reps.join(sorts.filter("n = 1"), "core").select("core", "wide", F.array((-F.col("back")).cast("int"), (F.col("wins") - 1 - F.col("back") + length).cast("int")).alias("spans"))
    placed = again.select("k1", "k2", "core", "wide", "pos").join(found.unionByName(alike), ["core", "wide"])
    parts = placed.select("k1", "k2", F.transform("spans", lambda x: x + F.col("pos")).alias("span"))
    # A set, as repeated rows share their key and give each span as often as they are repeated.
    out = materialize(parts.groupBy("k1", "k2").agg(F.flatten(F.collect_set("span")).alias("spans")), "spans", shrink=2)
    drop(again, reps)
    return out


def doubling_spans(docs: DataFrame, length: int = LENGTH, first: int = 8) -> DataFrame:
    """The same as spans(), by prefix doubling over every byte position; `first` (8 at most) bytes are the first rank."""
    rows = materialize(keyed(docs).select("k1", "k2", F.encode("text", "UTF-8").alias("data"), F.monotonically_increasing_id().alias("row")), "rows")
    n = partitions(docs.sparkSession)

    def start(batch):
        parts = []
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(data) >= length:
                codes = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), first).astype(np.int64)
                rank = np.zeros(len(codes), np.int64)
                for i in range(first):
                    rank = (rank << 8) | codes[:, i]
                parts.append((np.full(len(codes), row), np.arange(len(codes)), rank))
        return {f: np.concatenate([p[i] for p in parts]) if parts else [] for i, f in enumerate(("row", "pos", "a"))}

    schema = "row long, pos long, rank long"
    target = arrow_schema(schema)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted pairs of ranks to new ranks; a pair that stands alone goes. A rank is its place among this partition's pairs, beside the partition's number."""
        from pyspark import TaskContext

        base, held, index = TaskContext.get().partitionId() << 40, None, 0
        for batch in batches:
            row, pos, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if held is not None:
                row, pos, a, b = (np.concatenate([x, y]) for x, y in zip(held, (row, pos, a, b), strict=True))
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            last = int(np.flatnonzero(head)[-1])
            held = tuple(x[last:] for x in (row, pos, a, b))  # its pair may go on in the next batch
            yield _kept(row[:last], pos[:last], head[:last], base + index)
            index += int(head[:last].sum())
        if held is not None:
            yield _kept(held[0], held[1], np.arange(len(held[0])) == 0, base + index)

    def _kept(row: np.ndarray, pos: np.ndarray, head: np.ndarray, low: int) -> pa.RecordBatch:
        group = np.cumsum(head) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        return record_batch({"row": row[many], "pos": pos[many], "rank": low + group[many]}, target)

    def sorted_ranks(pairs: DataFrame) -> DataFrame:
        dealt = pairs.select("row", "pos", "a", "b").repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")
        return materialize(dealt.mapInArrow(rerank, schema), "ranks")

    size = first
    ranks = sorted_ranks(arrow_map(rows.select("row", "data"), start, "row long, pos long, a long").withColumn("b", F.lit(0).cast("long")))
    while size < length:
        step = min(size, length - size)
        ahead = ranks.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        before, ranks = ranks, sorted_ranks(ranks.withColumnRenamed("rank", "a").join(ahead, ["row", "pos"]))
        drop(before)
        size += step
    found = ranks.join(rows.select("row", "k1", "k2"), "row").select("k1", "k2", F.array("pos", F.col("pos") + length).alias("span"))
    out = materialize(found.groupBy("k1", "k2").agg(F.flatten(F.collect_set("span")).alias("spans")), "spans")
    drop(rows, ranks)
    return out


def merge(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs, starts and ends, of the union of [from, to) pairs; runs that touch are one."""
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    heads = np.flatnonzero(fresh)
    return pairs[heads, 0], reach[np.append(heads[1:], len(pairs)) - 1]


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, data, spans. While the keys of the rows that lose bytes are few, only those rows are shuffled."""
    data = keyed(docs).select("doc_id", "k1", "k2", F.encode("text", "UTF-8").alias("data"))
    keys = found.select("k1", "k2")
    if not _few(keys):
        return data.join(found, ["k1", "k2"], "left").select("doc_id", "data", "spans")
    keys = F.broadcast(keys)
    losing = data.join(keys, ["k1", "k2"], "left_semi").join(found, ["k1", "k2"]).select("doc_id", "data", "spans")
    return losing.unionByName(data.join(keys, ["k1", "k2"], "left_anti").select("doc_id", "data", F.lit(None).cast("array<long>").alias("spans")))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batch):
        out = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i, data in enumerate(batch.column(1).to_pylist()):
            own, starts, ends = batch.column(2)[i], (), ()
            if own.is_valid:
                starts, ends = merge(own.values.to_numpy())
                kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
            else:
                kept = data
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(starts))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    return arrow_map(_joined(docs, spans(docs, length)), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
