"""Near-duplicate groups by SetSketch registers.

Each text's word shingles give registers (exponentially spaced, truncated minima). Bands of register
values propose neighbours: in each bucket of a band, every document is paired with the bucket's
least, so a bucket gives as many pairs as it has documents. The likelihood of both register arrays
estimates each pair's similarity; pairs estimated at LOOSE or more tie documents into clusters.
Where some member is not tied to its bucket's least, that bucket's members that share fewer than
TIGHT of the least's registers are compared among themselves: leader after leader, each tied to those that
share LOOSE of its registers, and only those that share TIGHT leave with it. Buckets beyond BLOCK such
members are dealt to tasks by pairs of blocks. Within a cluster the full sets decide every link that could join two components, exactly: documents
outside the largest component so far are matched against all the others by an inverted index. A
cluster of up to BLOCK documents and BLOCK_SHINGLES is one task. In a larger one a few members are
hubs: every member is compared with the hubs, in as many tasks as the cluster has blocks. What that
leaves outside the largest component is then dealt out in blocks, and each meets every block of the
cluster. Only links that join components leave a task.

Texts of equal sets are one node throughout. Two documents of one bucket that share TIGHT - LOOSE of
their registers or more always enter one cluster, whoever else is in the bucket: if one leaves with a
leader, the other shares LOOSE with that leader. So a link at the threshold is missed only if no band
proposes it, of chance (1 - 0.8**5)**40, about 1e-7, or if its registers agree in fewer than 130 places
of 200 where 160 are expected, of chance about 2.5e-7.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of
fewer words than `width` has one shingle; repeated rows are in one component; component_id is the
least doc_id, nulls left aside; other columns stay behind; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, arrow_schema, drop, keyed, materialize, memo, partitions, record_batch, text_of
from .graph import components

#: Links: 100 * shared >= PERCENT * all.
PERCENT = 80
WIDTH = 2
LOOSE = 0.5
TIGHT = 0.85
BLOCK = 4000
BLOCK_SHINGLES = 4_000_000
BROADCAST_MEMBERS = 300_000
HUBS = 4
#: More pairs than this with one least document are dealt to SALT tasks.
HOT = 1000
SALT = 16


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2, n (set size), id (of the set), bands, registers."""

    def run(batch):
        from . import sketch

        words = memo("shingles", sketch.Words)
        out = {"doc_id": batch.column(0), "k1": batch.column(2), "k2": batch.column(3), "n": [], "id": [], "bands": [], "registers": []}
        for text in batch.column(1).to_pylist():
            own = sketch.shingles(text, words, width)
            out["n"].append(len(own))
            regs = sketch.registers(own) if len(own) else None
            out["id"].append(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own) & 0xFFFF) - 2**63)
            out["bands"].append(sketch.band_keys(regs) if len(own) else np.empty(0, np.int64))
            out["registers"].append(regs.tobytes() if len(own) else b"")
        return out

    schema = "doc_id long, k1 long, k2 long, n long, id long, bands array<long>, registers binary"
    return arrow_map(keyed(docs).select("doc_id", "text", "k1", "k2"), run, schema)


def proposals(sketched: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: ties at LOOSE or more that connect any two documents of a bucket that can be linked."""
    keys = sketched.select("id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    buckets = materialize(keys.join(shared.select("band", "low"), "band").filter("id != low").select("band", "id", "low"), "buckets", shrink=4)
    pairs = materialize(buckets.select("id", "low").distinct(), "pairs", shrink=4)
    ids = pairs.select("id").union(pairs.select(F.col("low").alias("id"))).distinct()
    # Few ids are broadcast, so that rows of equal sets meet in an aggregate that combines first, not in a join.
    wanted = sketched.join(F.broadcast(ids) if pairs.count() <= BROADCAST_MEMBERS else ids, "id", "left_semi")
    regs = wanted.select("id", "n", "registers").dropDuplicates(["id"])
    first = pairs.join(regs.select("id", F.col("n").alias("n_a"), F.col("registers").alias("a")), "id")
    # A least one with very many pairs is repeated for each salt, so that its pairs are dealt out; there are at most pairs / HOT of them.
    hot = pairs.groupBy("low").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("low", F.lit(SALT).alias("salts"))
    hot = materialize(hot, "hot", shrink=16)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_MEMBERS else hot
    lows = regs.select(F.col("id").alias("low"), F.col("n").alias("n_b"), F.col("registers").alias("b")).join(hot, "low", "left")
    lows = lows.select("low", "n_b", "b", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    first = first.join(hot, "low", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    both = first.join(lows, ["low", "salt"])

    def estimate(batch):
        from . import sketch

        n = batch.num_rows
        if not n:
            return None
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, -1) for i in (2, 4))
        n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (3, 5))
        same = (a == b).mean(axis=1)
        tied = (sketch.joint_estimate(a, b, n_a, n_b) >= LOOSE) | (same >= LOOSE)
        return {"id": batch.column(0), "low": batch.column(1), "tied": pa.array(tied), "tight": pa.array(same >= TIGHT)}

    judged = materialize(arrow_map(both.select("id", "low", "a", "n_a", "b", "n_b"), estimate, "id long, low long, tied boolean, tight boolean"), "judged", shrink=4)
    ties = judged.filter("tied").select(F.col("id").alias("u"), F.col("low").alias("v"))
    return ties.union(_ties_beside(buckets, judged, regs, block))


def _ties_beside(buckets: DataFrame, judged: DataFrame, regs: DataFrame, block: int) -> DataFrame:
    """u, v: ties within the buckets of which some member is not tied to the least."""
    open_lows = judged.filter("not tied").select("low").distinct()
    loose = judged.filter("not tight").join(open_lows, "low", "left_semi").select("id", "low", "tied")
    left = materialize(buckets.join(loose, ["id", "low"]).select("band", "id", "tied").distinct(), "left", shrink=4)
    sizes = left.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.count_if("tied").alias("t")).filter("c > 1 and t < c")
    sizes = sizes.select("band", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    rows = left.join(sizes, "band").select("band", "id", "tied", F.explode(_block_pairs("id")).alias("task")).join(regs.select("id", "registers"), "id")
    rows = rows.select("id", "band", F.col("task.i").alias("i"), F.col("task.j").alias("j"), "tied", "registers")
    rows = rows.repartition(partitions(regs.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j", "tied", "id")
    schema = "u long, v long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, tied, arrays = None, [], [], []

        def close() -> pa.RecordBatch:
            found = bucket_ties(np.frombuffer(b"".join(arrays), np.uint16).reshape(len(ids), -1), np.array(tied))
            return record_batch({"u": [ids[a] for a, _ in found], "v": [ids[b] for _, b in found]}, target)

        for batch in batches:
            for node, *task, own, registers in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if task != held:
                    if len(ids) > 1:
                        yield close()
                    held, ids, tied, arrays = task, [], [], []
                ids.append(node)
                tied.append(own)
                arrays.append(registers)
        if len(ids) > 1:
            yield close()

    return rows.mapInArrow(run, schema)


def bucket_ties(registers: np.ndarray, tied: np.ndarray) -> list[tuple[int, int]]:
    """Ties between the rows of registers, those marked tied being in one cluster already."""
    label = np.arange(len(registers))
    label[tied] = label[tied].min(initial=len(registers))
    left, ties = np.arange(len(registers)), []
    while len(left) and (label[left] != label[left[0]]).any():
        i, left = left[0], left[1:]
        same = (registers[left] == registers[i]).mean(axis=1)
        near = left[same >= LOOSE]
        met, at = np.unique(label[near], return_index=True)
        ties += [(int(i), int(j)) for j in near[at[met != label[i]]]]
        label[np.isin(label, met)] = label[i]
        left = left[same < TIGHT]
    return ties


def _block_pairs(node: str) -> Column:
    """The pairs of blocks, of `blocks` in all, that a node takes part in."""
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))


class _Merged:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


class _Index:
    """Which sets hold a shingle, of a list of sorted sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        self.heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.distinct, self.ends = values[self.heads], np.append(self.heads[1:], len(values))

    def linked(self, own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the sets linked with one more set, by whole sets."""
        at = np.minimum(np.searchsorted(self.distinct, own), len(self.distinct) - 1)
        at = at[self.distinct[at] == own]
        begins, lengths = self.heads[at], self.ends[at] - self.heads[at]
        if not len(begins):
            return np.empty(0, np.int64)
        places = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (100 * shared >= percent * (self.sizes + len(own) - shared)))


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links, by exact sets, that connect what all links connect; at most one fewer than sets."""
    n = len(sets)
    if n < 2:
        return []
    index, merged, links = _Index(sets), _Merged(n), []

    def look_up(i: int) -> None:
        for j in index.linked(sets[i], percent).tolist():
            if j != i and merged.join(i, j):
                links.append((i, j))

    # A few look-ups find the largest component; then every document outside it looks for its links.
    tried = set()
    for i in {int(np.argsort(index.sizes, kind="stable")[n // 2]), 0, n - 1, n // 3}:
        tried.add(i)
        look_up(i)
    largest = max(range(n), key=lambda i: merged.size[merged.find(i)])
    root = merged.find(largest)
    for i in [i for i in range(n) if merged.find(i) != root and i not in tried]:
        if merged.size[merged.find(i)] < n:
            look_up(i)
    return links


def crossing_links(some: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """some and others: a component so far, and a set. Links between the two lists that join components, by number."""
    place = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in [*some, *others]))}
    index, merged, links = _Index([s for _, s in others]), _Merged(len(place)), []
    for i, (component, own) in enumerate(some):
        for j in index.linked(own).tolist():
            if merged.join(place[component], place[others[j][0]]):
                links.append((i, j))
    return links


LINKS = "u long, v long"


def links(docs: DataFrame, sketched: DataFrame, width: int = WIDTH, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """u, v: verified links between sets' ids that connect what all links connect."""
    ties = components(proposals(sketched))
    own = sketched.select("id", "n", "k1", "k2")
    if ties.count() <= BROADCAST_MEMBERS:
        own = own.join(F.broadcast(ties.select("id")), "id", "left_semi")
    nodes = own.groupBy("id").agg(F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("rep"))
    members = materialize(ties.join(nodes, "id").select("id", "root", "n", "rep.k1", "rep.k2"), "members", shrink=8)
    sizes = members.groupBy("root").agg(_blocks(block, block_shingles).alias("blocks"))
    dealt = members.join(sizes, "root")
    rows = _with_texts(docs, dealt.filter("blocks = 1").select("id", "root", "k1", "k2", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("component")))
    out = _in_tasks(rows, width, lambda asking, asked: [(asked[a][0], asked[b][0]) for a, b in spanning_links([s for _, _, s in asked])])
    large = materialize(dealt.filter("blocks > 1"), "large", shrink=8)
    if not large.count():
        drop(large)
        return out
    by_hub = materialize(_hub_links(docs, large, width), "hub_links", shrink=8)
    return out.union(by_hub).union(_outside_links(docs, large, components(by_hub), width, block, block_shingles))


def _blocks(block: int, block_shingles: int) -> Column:
    """Blocks that a group of sets (n shingles each) is dealt into."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")


def _hub_links(docs: DataFrame, large: DataFrame, width: int) -> DataFrame:
    """u, v: links of large clusters' members with up to HUBS of them, drawn by a hash. Each hub goes to all blocks, every member to one."""
    spot = F.struct(F.xxhash64("id").alias("h"), "id", "k1", "k2")
    hubs = large.groupBy("root", "blocks", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("which")).agg(F.min(spot).alias("s"))
    hubs = hubs.select("s.id", "root", "s.k1", "s.k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("asks"))
    every = large.select("id", "root", "k1", "k2", _own_block("blocks").alias("i"), F.lit(0).alias("j"), F.lit(False).alias("asks"))
    rows = _with_texts(docs, hubs.unionByName(every).withColumn("component", F.col("id")))
    return _in_tasks(rows, width, _crossing)


def _outside_links(docs: DataFrame, large: DataFrame, joined: DataFrame, width: int, block: int, block_shingles: int) -> DataFrame:
    """u, v: links of the members that are outside the largest component of their cluster so far, with all members.

    joined: id, root (the component so far). Blocks of those outside meet blocks of all.
    """
    known = joined.select("id", F.col("root").alias("component"))
    state = large.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = materialize(state, "state", shrink=8)
    counts = state.groupBy("root", "component").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("root").agg(F.max(F.struct("c", "component")).alias("m")).select("root", F.col("m.component").alias("main"))
    outside = materialize(state.join(main, "root").filter("component != main").drop("main"), "outside", shrink=8)
    asking = outside.groupBy("root").agg(_blocks(block, block_shingles).alias("ask_blocks"))
    one, other = _own_block("ask_blocks"), _own_block("blocks")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = outside.join(asking, "root").select("id", "root", "k1", "k2", "component", one.alias("i"), F.explode(every("blocks")).alias("j"), F.lit(True).alias("asks"))
    asked = state.join(asking, "root").select("id", "root", "k1", "k2", "component", F.explode(every("ask_blocks")).alias("i"), other.alias("j"), F.lit(False).alias("asks"))
    return _in_tasks(_with_texts(docs, asks.unionByName(asked)), width, _crossing)


def _own_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), F.col(blocks)).cast("int")


def _crossing(asking: list, asked: list) -> list[tuple[int, int]]:
    if not asking or not asked:
        return []
    found = crossing_links([(c, s) for _, c, s in asking], [(c, s) for _, c, s in asked])
    return [(asking[i][0], asked[j][0]) for i, j in found]


def _with_texts(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt (id, root, i, j, asks, component, k1, k2) with the texts of their rows. Few ids are broadcast, after a count."""
    texts = keyed(docs).select("k1", "k2", "text")
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_MEMBERS else dealt
    return texts.join(dealt, ["k1", "k2"]).select("id", "root", "i", "j", "asks", "component", "text")


def _in_tasks(rows: DataFrame, width: int, find) -> DataFrame:
    """find(asking, asked), lists of (id, component, set), for the rows of each (root, i, j); rows of one id count once."""
    rows = rows.repartition(partitions(rows.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "asks", "id")
    target = arrow_schema(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import sketch

        words, held, lists, last = memo("shingles", sketch.Words), None, ([], []), None

        def close() -> pa.RecordBatch:
            found = find(lists[1], lists[0])
            return record_batch({"u": [u for u, _ in found], "v": [v for _, v in found]}, target)

        for batch in batches:
            for node, *task, asks, component, text in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if task != held:
                    if held is not None:
                        yield close()
                    held, lists, last = task, ([], []), None
                if last != (node, asks):  # not another row of the same set
                    last = (node, asks)
                    lists[asks].append((node, component, sketch.shingles(text, words, width)))
        if held is not None:
            yield close()

    return rows.mapInArrow(run, LINKS)


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, kept; one row for each row of docs."""
    sketched = materialize(sketches(docs, width), "sketches")
    rooted = components(links(docs, sketched, width))
    rows = sketched.select("doc_id", "k1", "k2", "n", "id")
    rows = materialize(rows.join(rooted, "id", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("root", "id"))).select("doc_id", "k1", "k2", "n", "group"), "grouped", shrink=4)
    least = materialize(rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "least", shrink=8)
    out = rows.join(least, "group", "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that are their component's least doc_id, with all columns; rows that repeat one stay out.

    A text without shingles stays.
    """
    a, b, c = "__tidemark_k1", "__tidemark_k2", "__tidemark_n"
    kept = groups(docs, width).filter("kept").groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.count(F.lit(1)).alias(c))
    kept = materialize(kept, "kept", shrink=8)
    marked = docs.withColumn(a, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(b, F.xxhash64(text_of()))
    out = marked.join(kept, [a, b])
    if kept.filter(F.col(c) > 1).limit(1).count():
        once = Window.partitionBy(a, b).orderBy(F.lit(0))
        out = out.withColumn(c, F.row_number().over(once)).filter(F.col(c) == 1)
    return out.select(*docs.columns)
