"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Every text is cut into words once. The index stores a posting (term, document, position) for each
occurrence of any of the benchmark's terms, and one closing posting for each row, which tells its
number of words. A phrase is looked up by intersecting posting lists from its rarest term on: the
list of the rarest gives the places where the phrase would begin; they are intersected with the
list of the next rarest, offsets taken off; what is left is matched with the postings of all its
other terms at once, and is a match if every offset is there. Proximity searches read the same
postings, block by block of positions.

Defined results: null texts have no words; empty texts and items match nothing; items without an
id are left out; an item of fewer than WINDOW words is one phrase; repeated rows get equal
results; among equally rare terms the first in the phrase is looked up first; other columns stay
behind. Whole texts are indexed. Tables of the benchmark are broadcast up to BROADCAST_WINDOWS phrases, tables
of matches up to BROADCAST_PLACES rows, both counted first; larger ones are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, drop, keyed, materialize, text_of

WINDOW = 10
BROADCAST_WINDOWS = 200_000
BROADCAST_PLACES = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The term of a row's closing posting begins with this, which is in no word.
CLOSING = "\x00"
_KEY = ["k1", "k2"]


def fold(word: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(word, UPPER, LOWER)


def pieces(text: Column) -> Column:
    """Words by position; the first and the last may be empty and are then no words."""
    return F.split(text, BETWEEN, -1)


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase_id, words, items: each distinct phrase and the ids, as strings, that hold it."""
    words = F.filter(F.transform(pieces(text_of()), fold), lambda w: w != "")
    runs = F.when(F.size("words") >= window, F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.slice("words", i, window))).when(F.size("words") > 0, F.array("words"))
    return (
        items.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
        .filter("item is not null")
        .select("item", F.explode(runs).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("phrase_id", F.xxhash64(F.array_join("words", " ")))
    )


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _closing(split: Column) -> Column:
    """The closing term of a row: how many of the first and the last piece are no words, and whether doc_id is null."""
    outer = F.when(F.element_at(split, 1) == "", 1).otherwise(0) + F.when((F.size(split) > 1) & (F.element_at(split, -1) == ""), 1).otherwise(0)
    return F.concat(F.lit(CLOSING), outer.cast("string"), F.when(F.col("doc_id").isNull(), "n").otherwise(""))


def index(docs: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """k1, k2, position, term: the postings of all terms of the phrases, and a closing one for each row."""
    spark = docs.sparkSession
    terms = found.select(F.explode("words").alias("term")).distinct()
    closing = spark.createDataFrame([(f"{CLOSING}{n}{null}",) for n in range(3) for null in ("", "n")], "term string")
    known = terms.unionByName(closing).select(F.lower("term").alias("loose"), "term")
    split = keyed(docs).select("doc_id", *_KEY, pieces(F.col("text")).alias("pieces"))
    words = split.select(*_KEY, F.posexplode(F.concat("pieces", F.array(_closing(F.col("pieces"))))).alias("position", "word"))
    # Terms meet by a quick lower-casing of all letters; then A-Z alone decide, which is slow to work out and seldom needed.
    met = words.withColumn("loose", F.lower("word")).join(_hint(known, small), "loose")
    same = F.when(F.col("word") == F.col("loose"), F.col("loose") == F.col("term")).otherwise(fold(F.col("word")) == F.col("term"))
    return met.filter(same).select(*_KEY, "position", "term")


class PositionalIndex:
    """Stored postings of a corpus for a benchmark, and searches over them."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> None:
        self.window = window
        self.phrases = materialize(phrases(items, window), "phrases", shrink=16)
        self.small = self.phrases.count() <= BROADCAST_WINDOWS
        self.postings = materialize(index(docs, self.phrases, self.small), "postings")
        self.lists = self.postings.filter(~F.startswith("term", F.lit(CLOSING)))
        counts = materialize(self.lists.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts", shrink=16)
        # Phrases with a term that the corpus lacks go; the others list their terms from the rarest on.
        terms = self.phrases.select("phrase_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
        ranked = terms.join(_hint(counts, self.small), "term").groupBy("phrase_id", "length").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("by_rarity"))
        self.ranked = materialize(ranked.filter(F.size("by_rarity") == F.col("length")), "ranked", shrink=16)

    def close(self) -> None:
        """Remove the stored tables, once what was read from them is written."""
        drop(self.phrases, self.postings, self.ranked)

    def rows(self) -> DataFrame:
        """doc_id, k1, k2, n_words for each row of the corpus, from the closing postings."""
        ends = self.postings.filter(F.startswith("term", F.lit(CLOSING)))
        number = F.substring("term", 2, 1).cast("long")
        return ends.select(F.when(~F.endswith("term", F.lit("n")), F.col("k1")).alias("doc_id"), *_KEY, (F.col("position") - number).alias("n_words"))

    def _nth(self, n: int) -> DataFrame:
        """phrase_id, term, offset: of each phrase of more than n terms the n-th rarest."""
        return self.ranked.filter(F.size("by_rarity") > n).select("phrase_id", F.col("by_rarity")[n]["term"].alias("term"), F.col("by_rarity")[n]["offset"].alias("offset"))

    def _list(self, n: int) -> DataFrame:
        """phrase_id, k1, k2, start: where a phrase would begin by its n-th rarest term."""
        return self.lists.join(_hint(self._nth(n), self.small), "term").select("phrase_id", *_KEY, (F.col("position") - F.col("offset")).alias("start"))

    def exact(self) -> DataFrame:
        """phrase_id, k1, k2, start, length: where a phrase stands word for word."""
        place = ["phrase_id", *_KEY, "start"]
        one = self._list(0).join(_hint(self.ranked.filter("length = 1").select("phrase_id"), self.small), "phrase_id", "left_semi")
        begun = self._list(0).join(self._list(1), place, "left_semi")
        places = materialize(begun.distinct(), "places", shrink=4)
        # The other terms at their offsets: a place stays if none is missing.
        others = self.ranked.select("phrase_id", (F.col("length") - 2).alias("wanted"), F.explode(F.slice("by_rarity", 3, F.size("by_rarity"))).alias("t"))
        others = others.select("phrase_id", "wanted", "t.offset", "t.term")
        needed = places.join(_hint(others, self.small), "phrase_id").select(*place, "wanted", "offset", "term", (F.col("start") + F.col("offset")).alias("position"))
        needed = materialize(needed, "needed", shrink=4)
        few = needed.count() <= BROADCAST_PLACES
        # Only documents that hold a place are asked for the other terms; while they are few, the rest of the postings is not shuffled.
        held = materialize(places.select(*_KEY).distinct(), "held", shrink=4)
        lists = self.lists.join(F.broadcast(held), _KEY, "left_semi") if held.count() <= BROADCAST_PLACES else self.lists
        there = lists.join(_hint(needed, few), [*_KEY, "position", "term"]).groupBy(*place, "wanted").agg(F.count_distinct("offset").alias("there"))
        whole = there.filter("there = wanted").select(*place)
        two = places.join(_hint(self.ranked.filter("length = 2").select("phrase_id"), self.small), "phrase_id", "left_semi")
        out = one.distinct().unionByName(two).unionByName(whole)
        return out.join(_hint(self.ranked.select("phrase_id", "length"), self.small), "phrase_id")

    def near(self, slop: int = 0) -> DataFrame:
        """phrase_id, k1, k2, position: where all words of a phrase stand within reach (its window and slop) of its rarest term."""
        reach = self.window - 1 + slop
        block = max(1, reach)
        anchor = self.lists.join(_hint(self._nth(0), self.small), "term").select("phrase_id", *_KEY, F.col("position").alias("at")).distinct()
        own = F.floor(F.col("at") / block)
        anchor = anchor.withColumn("block", F.explode(F.array(own - 1, own, own + 1)))
        kinds = self.ranked.select("phrase_id", F.array_distinct("by_rarity.term").alias("terms"))
        wanted = kinds.select("phrase_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
        asked = anchor.join(_hint(wanted, self.small), "phrase_id")
        met = asked.join(self.lists.withColumn("block", F.floor(F.col("position") / block)), [*_KEY, "block", "term"]).filter(F.abs(F.col("position") - F.col("at")) <= reach)
        found = met.groupBy("phrase_id", *_KEY, "at", "wanted").agg(F.count_distinct("term").alias("there")).filter("there = wanted")
        return found.select("phrase_id", *_KEY, F.col("at").alias("position"))


def per_document(matches: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """matches: phrase_id, k1, k2, start, length. k1, k2, n_hit (words inside any match), items (ids, sorted as strings)."""
    end = F.col("start") + F.col("length")
    before = Window.partitionBy(*_KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select(*_KEY, "start", "length").distinct()
    fresh = spans.select(*_KEY, (end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("fresh"))
    hit = fresh.groupBy(*_KEY).agg(F.sum(F.greatest("fresh", F.lit(0))).cast("long").alias("n_hit"))
    named = matches.select(*_KEY, "phrase_id").distinct().join(_hint(found.select("phrase_id", "items"), small), "phrase_id")
    items = named.select(*_KEY, F.explode("items").alias("item")).distinct().groupBy(*_KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return hit.join(items, _KEY)


def _hits(built: PositionalIndex) -> tuple[DataFrame, bool]:
    """k1, k2, n_hit, items for each document that holds a phrase, and whether these are few enough to broadcast."""
    matches = materialize(built.exact(), "matches", shrink=4)
    found = materialize(per_document(matches, built.phrases, built.small), "hits", shrink=4)
    drop(matches)
    return found, found.count() <= BROADCAST_PLACES


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (array of ids)."""
    built = PositionalIndex(docs, items, window)
    found, few = _hits(built)
    joined = built.rows().join(_hint(found, few), _KEY, "left")
    nothing = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no phrase of the items, with all their columns."""
    k1, k2 = "__tidemark_k1", "__tidemark_k2"
    built = PositionalIndex(docs, items, window)
    found, few = _hits(built)
    built.close()
    bad = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    marked = docs.withColumn(k1, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(k2, F.xxhash64(text_of()))
    return marked.join(_hint(bad, few), [k1, k2], "left_anti").select(*docs.columns)
