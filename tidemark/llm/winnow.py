"""Document fingerprints by winnowing.

Rolling hashes of all runs of GRAM code points; from each window of WINDOW of them the minimum is
kept, the rightmost of equal ones, with its position. So two texts that share GRAM + WINDOW - 1
consecutive code points share a kept hash. A text with fewer code points than GRAM has one hash, of
the whole text, at position 0. As a string, a fingerprint is the base64 of one 6-byte record for
each kept hash: one byte for the step from the last kept position, five for the hash.

Defined results: a null text is empty; the empty text has the empty fingerprint, and two empty
fingerprints have likeness 1; repeated rows get equal results, in order one after the other; other
columns stay behind; texts are read whole, in blocks, so memory beside a text is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, partitions, range_ends, range_part, record_batch, small_batches
from .rolling import kgrams, mix, window_minima

GRAM = 24
WINDOW = 77


def kept(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions, rising, and 40-bit hashes."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = mix(kgrams(codes, min(GRAM, len(codes))))
    at = window_minima(hashes, WINDOW)
    return at, hashes[at] >> np.uint64(24)


def to_string(positions: np.ndarray, hashes: np.ndarray) -> str:
    record = np.empty((len(hashes), 6), np.uint8)
    record[:, 0] = np.diff(positions, prepend=0)
    record[:, 1:] = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return base64.b64encode(record.tobytes()).decode()


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    record = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(record), 8), np.uint8)
    wide[:, :5] = record[:, 1:]
    return np.cumsum(record[:, 0].astype(np.int64)), wide.reshape(-1).view("<u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; 1 if there are none."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for each row of docs."""
    def run(batch):
        return {"doc_id": batch.column(0), "fingerprint": [to_string(*kept(t)) for t in batch.column(1).to_pylist()]}

    return arrow_map(keyed(docs).select("doc_id", "text"), run, "doc_id long, fingerprint string")


def _bounds(quantiles: list[int], parts: int) -> list[tuple[int, int]]:
    """Rising lower ends (turn, k2) of all ranges but the first. An id that holds several quantiles is cut by k2, the hash of the text."""
    times = Counter(quantiles)
    out: set[tuple[int, int]] = set()
    for turn, n in times.items():
        out.update((turn, -(2**63) + (2**64 * i) // n) for i in range(n))
    return sorted(out)[: parts - 1]


def in_turn(docs: DataFrame) -> DataFrame:
    """part, turn, k1, k2, doc_id, text, lead: rows dealt to ranges of falling doc_id, each with a copy (lead) of the row that follows it.

    turn is the id with all bits turned, so that it rises where the id falls. Ranges come from
    quantiles of it, in which long texts count for more; an id that fills several ranges is cut by the hash of the text. The first row
    of each range is found by an aggregate, and its text goes twice, to its own range and to the
    range before. So one shuffle moves the texts once.
    """
    spark = docs.sparkSession
    base = keyed(docs).withColumn("turn", F.bitwise_not("k1"))
    n = partitions(spark)
    ids = base.select("turn", "k2")
    bounds = _bounds(range_ends(base, "turn", F.length("text") / 2048, n), n)
    base, ids = (x.withColumn("part", range_part(bounds, "turn", "k2")) for x in (base, ids))
    firsts = {r["part"]: tuple(r["f"]) for r in ids.groupBy("part").agg(F.min(F.struct("turn", "k2")).alias("f")).collect()}
    parts = sorted(firsts)
    before = [(*firsts[p], parts[i - 1]) for i, p in enumerate(parts)]
    if not before:
        return base.select("part", "turn", "k1", "k2", "doc_id", "text", F.lit(False).alias("lead"))
    edge = spark.createDataFrame(before, "turn long, k2 long, other int")  # one row per range
    copies = base.join(F.broadcast(edge), ["turn", "k2"], "left")
    own = F.struct(F.col("part").alias("p"), F.lit(False).alias("l"))
    targets = F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("other").alias("p"), F.lit(True).alias("l"))))
    dealt = copies.select("turn", "k1", "k2", "doc_id", "text", F.explode(targets).alias("t"))
    return dealt.select(F.col("t.p").alias("part"), "turn", "k1", "k2", "doc_id", "text", F.col("t.l").alias("lead"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the first half of the next document's text, by falling doc_id, in place of
    its own second half. Equal ids go by a hash of the text.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = arrow_schema(schema)
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, its positions and hashes
        for batch in batches:
            out = {f.name: [] for f in target}
            for part, doc_id, text, lead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = kept(text)
                if held is not None and held[0] == part:
                    _, held_id, held_text, held_own = held
                    half = len(held_text) // 2
                    edited = held_text[: len(held_text) - half] + text[:half]
                    print_ = kept(edited)
                    row = (held_id, len(held_text), hashlib.sha256(edited.encode()).hexdigest(), to_string(*held_own), to_string(*print_), likeness(held_own[1], print_[1]), likeness(held_own[1], own[1]))
                    for f, value in zip(target, row, strict=True):
                        out[f.name].append(value)
                held = None if lead else (part, doc_id, text, own)
            yield record_batch(out, target)

    rows = in_turn(docs).repartitionById(partitions(spark), F.col("part"))
    # A copy of the following row comes last in its part.
    rows = rows.sortWithinPartitions("part", "lead", "turn", "k2")
    return rows.select("part", "doc_id", "text", "lead").mapInArrow(run, schema)
