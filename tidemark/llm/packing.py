"""Packing along a space-filling curve.

Each document's ids are counted in hashed buckets, the counts projected to DIMENSIONS numbers and
these turned into a key on a Hilbert curve. Documents are range-sorted by that key; the ids in this
order are one stream, cut every `size` ids into sequences. So each sequence but the last is full,
and neighbours in it lie near each other on the curve.

Defined results: a null text is empty and has only the closing id; equal keys go by a hash of
doc_id and text, so a hot key is split as any other; repeated rows are documents of their own; an
empty table gives an empty table; other columns stay behind. Texts of any length are packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed, materialize, partitions, range_ends, range_part, record_batch, small_batches

SIZE = 4096
CLOSING = 2
DIMENSIONS = 3
ORDER_BITS = 10
HASHED = 512


def hilbert(points: np.ndarray, bits: int = ORDER_BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of coordinates, all below 2**bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    # From the coarsest bit on, each quadrant's part of the curve is mirrored or turned; this undoes it.
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            turned = (x[i] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= (x[-1] >> b & 1) * ((1 << b) - 1)
    distance = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            distance = distance << 1 | ((v ^ flip) >> b & 1)
    return distance


_PROJECTION = np.random.default_rng(20240501).choice([-1.0, 1.0], (HASHED, DIMENSIONS))
_SLOT = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int64)


def curve_keys(rows: list[bytes]) -> np.ndarray:
    """For each document its hashed counts of ids, square-rooted and scaled to length 1, projected, squashed to the grid."""
    counts = np.empty((len(rows), HASHED))
    for i, data in enumerate(rows):
        counts[i] = np.bincount(_SLOT[np.frombuffer(data, "<u2")], minlength=HASHED)
    counts = np.sqrt(counts)
    places = counts @ _PROJECTION / np.maximum(1.0, np.linalg.norm(counts, axis=1, keepdims=True))
    return hilbert((((1 << ORDER_BITS) - 1) / (1.0 + np.exp(-places / 2))).astype(np.int64))


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, spot (place in the order), tokens, ids (16 bits each, with the closing id)."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, spot long, tokens long, ids binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import word_tokenizer

        tokenizer = word_tokenizer(vocabulary)
        closing = np.array([CLOSING], "<u2").tobytes()
        for batch in batches:
            if batch.num_rows:
                rows = [data + closing for data in tokenizer.encode(batch.column(1).to_pylist())]
                spots = curve_keys(rows) << 32 | batch.column(2).to_numpy()
                yield record_batch({"doc_id": batch.column(0), "spot": pa.array(spots), "tokens": [len(data) // 2 for data in rows], "ids": rows}, target)

    tie = F.shiftrightunsigned(F.xxhash64("k1", "k2"), 32)
    return keyed(docs).select("doc_id", "text", tie.alias("tie")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    table = materialize(tokenized(docs, vocabulary), "ids", "snappy")  # ids hardly shrink
    n = partitions(spark)
    # Range bounds: quantiles of the place in the order, as many as there are partitions; long documents count for more.
    bounds = sorted(set(range_ends(table, "spot", F.col("tokens") / 512, n)))
    ranged = table.withColumn("part", range_part([(b,) for b in bounds], "spot"))
    totals = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum("tokens").alias("s")).collect()}
    offsets, done = {}, 0
    for p in sorted(totals):
        offsets[p] = done
        done += totals[p]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            out = {f.name: [] for f in target}
            for doc_id, p, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                place, total, start = at.get(p, offsets[p]), len(data) // 2, 0
                while start < total:
                    offset = place % size
                    length = min(size - offset, total - start)
                    for name, value in (("doc_id", doc_id), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(_wide(data[2 * start : 2 * (start + length)]))), ("doc_tokens", total), ("sequence_id", place // size), ("offset", offset)):
                        out[name].append(value)
                    start += length
                    place += length
                at[p] = place
            yield record_batch(out, target)

    order = ranged.repartitionById(n, F.col("part")).sortWithinPartitions("part", "spot", F.col("doc_id").asc_nulls_first())
    return order.select("doc_id", "part", "ids").mapInArrow(run, schema)


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()
