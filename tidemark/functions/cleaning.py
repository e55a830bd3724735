"""Column macros that read messy exports: numbers, flags, dates, categories, keyed values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that mean nothing is there; texts of yes and no; date patterns in the order tried.
BLANKS = ["", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "missing", "unknown", "-", "--", "?", "not available", "not_available"]
YES = ["1", "y", "yes", "true", "t", "ja", "j"]
NO = ["0", "n", "no", "false", "f", "nee"]
DATE_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "M-d-yyyy", "M/d/yyyy", "MMMM yyyy", "MMM yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy"]


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c with c evaluated once, however often f uses it, so that plans do not grow with nesting."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c.cast("string"), " ", " "))


def _blank(t: Column) -> Column:
    return t.isNull() | F.lower(t).isin(BLANKS)


def is_blank(c: Column | str) -> Column:
    return bound(text(c), _blank)


def clean(c: Column | str) -> Column:
    return bound(text(c), lambda t: F.when(~_blank(t), t))


def number(c: Column | str) -> Column:
    """value, ambiguous. The last separator is the decimal one; one that repeats, or a single one before exactly three digits, parts thousands (the latter is ambiguous)."""
    bare = F.regexp_replace(F.regexp_replace(clean(c), r"(?i)eur|usd|gbp|[€$£]", ""), r"[\s ]", "")
    return bound(bare, _number)


def _number(bare: Column) -> Column:
    return bound(F.struct(bare.rlike(r"^\(.*\)$").alias("negative"), F.regexp_replace(bare, r"[()]", "").alias("t")), lambda x: _signed(x["negative"], x["t"]))


def _signed(negative: Column, t: Column) -> Column:
    commas, dots = (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit(""))) for s in (",", "."))
    no_commas, no_dots = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit("."), F.lit(""))
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    three = t.rlike(r"^[+-]?[1-9]\d{0,2}[.,]\d{3}$")
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(comma_last, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when((commas > 1) | (dots > 1) | three, F.replace(no_commas, F.lit("."), F.lit("")))
        .when(commas == 1, F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(t)
    )
    value = bound(plain, lambda p: F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p).try_cast("double"))
    return F.struct(F.when(negative, -value).otherwise(value).alias("value"), F.coalesce(three, F.lit(False)).alias("ambiguous"))


def boolean(c: Column | str) -> Column:
    """1, 0 or null; other numbers are 1 if positive."""
    pair = F.struct(F.lower(clean(c)).alias("low"), number(c)["value"].alias("n"))
    return bound(pair, lambda p: F.when(p["low"].isin(YES), 1).when(p["low"].isin(NO), 0).when(p["n"].isNotNull(), (p["n"] > 0).cast("int")))


def capped_count(c: Column | str) -> Column:
    """count, capped: `10+` is 10 and capped."""
    pair = F.struct(F.regexp_extract(clean(c), r"^(\d+)\s*\+$", 1).try_cast("double").alias("top"), number(c)["value"].alias("n"))
    n = lambda p: F.coalesce(p["top"], p["n"])
    return bound(pair, lambda p: F.struct(n(p).alias("count"), F.when(n(p).isNotNull(), p["top"].isNotNull().cast("int")).alias("capped")))


def date(c: Column | str, day_first: bool = True) -> Column:
    """The day, by the first pattern that fits; with month first, the slash patterns change places."""
    patterns = list(DATE_PATTERNS)
    if not day_first:
        a, b = patterns.index("d/M/yyyy"), patterns.index("M/d/yyyy")
        patterns[a], patterns[b] = patterns[b], patterns[a]
    tidy = F.regexp_replace(F.initcap(F.lower(clean(c))), r"(\d)t(\d)", "$1T$2")
    return bound(tidy, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in patterns], t.try_cast("timestamp")).cast("date"))


def day_first(df: DataFrame, column: str) -> DataFrame:
    """day_first, verdict: from components above 12 in slashed or dashed dates of the whole column."""
    parts = df.select(clean(column).alias("t")).filter("t is not null").select(F.regexp_extract("t", r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", 1).try_cast("int").alias("a"), F.regexp_extract("t", r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", 2).try_cast("int").alias("b"))
    counts = parts.agg(F.count_if(F.col("a") > 12).alias("first"), F.count_if(F.col("b") > 12).alias("second"))
    verdict = F.when((F.col("first") > 0) & (F.col("second") > 0), "MIXED").when(F.col("second") > 0, "month-first").when(F.col("first") > 0, "day-first").otherwise("assumed day-first")
    return counts.select((verdict != "month-first").alias("day_first"), verdict.alias("verdict"))


def dates_in(c: Column | str) -> Column:
    """The parts of a cell with several dates, as text: a JSON list, or parted by semicolons or bars."""
    def parts(t: Column) -> Column:
        listed = F.when(t.startswith("["), F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>"))
        return F.coalesce(listed, F.split(t, r"[;|]"))

    return F.coalesce(F.filter(F.transform(bound(clean(c), parts), lambda p: F.trim(p)), _blank_not), F.array().cast("array<string>"))


def _blank_not(t: Column) -> Column:
    return ~_blank(t)


def category(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, by an alias if there is one, else with runs of other characters as underscores, by an alias again."""
    low = F.lower(clean(c))
    snake = lambda t: F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    if not aliases:
        return F.nullif(snake(low), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    pair = bound(low, lambda t: F.struct(t.alias("low"), snake(t).alias("snake")))
    return bound(pair, lambda p: F.coalesce(F.try_element_at(known, p["low"]), F.try_element_at(known, p["snake"]), F.when(p["snake"] != "", p["snake"])))


def keyed_number(c: Column | str, keys: list[str]) -> Column:
    """The number under one of keys in a JSON object, or behind a key in text, or the cell as a number."""

    def found(t: Column) -> Column:
        json = F.replace(t, F.lit("'"), F.lit('"'))
        keyed = F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])
        loose = [F.regexp_extract(t, rf"(?i){k}\D{{0,3}}(\d+)", 1).try_cast("double") for k in keys]
        return F.coalesce(number(keyed)["value"], *loose, number(t)["value"])

    return bound(clean(c), found)


def postcode_area(c: Column | str) -> Column:
    """Leading letters (up to three) in capitals, else the first two digits."""
    pair = bound(F.upper(clean(c)), lambda t: F.struct(F.regexp_extract(t, r"^([A-Z]{1,3})", 1).alias("a"), F.regexp_extract(t, r"(\d{2})", 1).alias("d")))
    return bound(pair, lambda p: F.when(p["a"] != "", p["a"]).when(p["d"] != "", p["d"]))


def age(c: Column | str) -> Column:
    return bound(number(c)["value"], lambda n: F.when((n >= 16) & (n <= 110), n))


def share(c: Column | str) -> Column:
    """A fraction; above 1 it was a percentage."""
    return bound(number(c)["value"], lambda n: F.when(n > 1, n / 100).otherwise(n))


@dataclass(frozen=True)
class Parsed:
    column: str
    kind: str
    value: Column


def report(df: DataFrame, parsed: list[Parsed], warn: float = 0.10) -> DataFrame:
    """column, parsed_as, n_rows, n_parsed, n_null_or_failed, pct_lost, notes: one aggregate for all columns.

    Lost are cells that have text which could not be read.
    """
    pairs = []
    for p in parsed:
        there, got = ~is_blank(f"`{p.column}`"), p.value.isNotNull()
        pairs.append(F.struct(F.lit(p.column).alias("column"), F.lit(p.kind).alias("parsed_as"), F.count(F.lit(1)).alias("n_rows"), F.count_if(got).alias("n_parsed"), F.count_if(~got).alias("n_null_or_failed"), F.coalesce(F.try_divide(100.0 * F.count_if(there & ~got), F.count_if(there)), F.lit(0.0)).alias("pct_lost")))
    rows = df.agg(F.array(*pairs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("notes", F.when(F.col("pct_lost") > 100 * warn, F.lit("many values could not be read")).otherwise(F.lit("")))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by an explicit order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)
