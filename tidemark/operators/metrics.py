"""Scores against outcomes, one feature at a time or all at once, by sorted cumulative sums.

Value counts come first: a cumulative window runs over distinct values of one feature, not over rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

MINIMUM = 20
CLIP = 1e-6
SHARES = (5, 10, 20)
#: Ranges into which values are cut for running sums.
PARTS = 64


def long(frame: DataFrame, names: list[str], keep: list[str], kind: str = "double") -> DataFrame:
    """feature, value and the kept columns: one row per row and feature, by explode of one array."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast(kind).alias("value")) for n in names])
    return frame.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def below(counts: DataFrame, by: list[str], sums: list[str], parts: int = PARTS) -> DataFrame:
    """counts (by, value, sums; one row per value) with below_<sum>: the total over smaller values of the same `by`.

    Values are cut into ranges by approximate quantiles; a running sum within each range meets the
    totals of the ranges before it. So a feature of very many values is not one task's, and the sums are exact.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 10 * parts).alias("_e"))
    dealt = counts.join(F.broadcast(cuts), by)  # one row per feature
    dealt = dealt.withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col("value")))).drop("_e")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = {f"_w_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    summed = dealt.withColumns(running).join(F.broadcast(totals), [*by, "_b"])  # features x parts rows
    return summed.select(*counts.columns, *[(F.col(f"_o_{s}") + F.col(f"_w_{s}")).alias(f"below_{s}") for s in sums])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, q: exact quantiles of the values that are not null, linearly interpolated, from running counts."""
    keys = by or ["_all"]
    source = rows if by else rows.withColumn("_all", F.lit(1))
    counts = source.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranked = below(counts, keys, ["c"])
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("_n"))
    ranked = ranked.join(F.broadcast(sizes), keys)  # one row per feature

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below_c") <= place) & (place < F.col("below_c") + F.col("c")), F.col("value")))

    places = [F.lit(p) * (F.col("_n") - 1) for p in shares]
    parts = []
    for i, x in enumerate(places):
        parts += [F.max(x - F.floor(x)).alias(f"_f{i}"), at(F.floor(x)).alias(f"_a{i}"), at(F.ceil(x)).alias(f"_z{i}")]
    found = ranked.groupBy(*keys).agg(*parts)
    q = F.array(*[F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}") for i in range(len(shares))])
    out = found.select(*keys, q.alias("q"))
    return out if by else out.drop("_all")


def spread(frame: DataFrame, score: str, *more: Column) -> Row:
    """One pass: n, cuts (score bounds of about equal numbers of rows) and more."""
    cuts = F.percentile_approx(score, [i / PARTS for i in range(1, PARTS)], 10 * PARTS)
    return frame.agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts"), *more).first()


def positions(frame: DataFrame, score: str, keep: list[str], tie: list[str], cuts: list[float] | None = None) -> DataFrame:
    """The kept columns and pos: places from 0 by falling score, ties by the tie columns; no task sorts all rows. cuts, if known, are those of spread()."""
    rows = frame.select(F.col(score).alias("value"), *[c for c in keep if c not in tie], *tie)
    cuts = sorted(set((spread(frame, score)["cuts"] if cuts is None else cuts) or []))
    rows = rows.withColumn("_b", -F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e <= F.col("value"))) if cuts else F.lit(0))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("_b", F.coalesce(F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.col("value").desc(), *tie)) - 1)
    return numbered.join(F.broadcast(before), "_b").select(*keep, (F.col("_r") + F.col("before")).alias("pos"))  # at most PARTS rows


def _ranked_auc(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts: by, value, pos, neg (sums per distinct value). by, n_pos, n_neg, n_values, area."""
    won = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    sums = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count(F.lit(1)).alias("n_values"), F.sum("won").alias("won")]
    out = below(counts, by, ["neg"]).withColumn("won", won).groupBy(*by).agg(*sums)
    return out.withColumn("area", F.try_divide("won", F.col("n_pos") * F.col("n_neg"))).drop("won")


def auc(frame: DataFrame, value: str, label: str, by: list[str] | None = None) -> DataFrame:
    """by, n_pos, n_neg, n_values, area: the chance that a positive has the larger value, ties counting half."""
    by = by or []
    out = frame if by else frame.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    counts = out.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = _ranked_auc(counts, keys)
    return ranked if by else ranked.drop("_all")


def numeric_scan(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, auc (the better direction), auc_missing, n_unique, null_share, cardinality_ratio, n: of numeric features."""
    rows = long(frame, names, [label])
    counts = rows.groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), F.count(F.lit(1)).alias("c"))
    areas = _ranked_auc(counts.filter("value is not null"), ["feature"])
    broken = F.col("value") != F.round("value")
    totals = counts.groupBy("feature").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("c"))).alias("there"),
        F.sum(F.when(F.col("value").isNull(), F.col("pos"))).alias("null_pos"),
        F.sum(F.when(F.col("value").isNull(), F.col("neg"))).alias("null_neg"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
        F.count("value").alias("n_unique"),
        F.sum(F.when(broken, F.col("c"))).alias("fractions"),
    )
    out = totals.join(areas.select("feature", "n_pos", "n_neg", "n_values", "area"), "feature", "left")
    there = F.coalesce("there", F.lit(0))
    fits = (there >= MINIMUM) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_values") > 1)
    continuous = F.coalesce("fractions", F.lit(0)) > 0.01 * there
    return out.select(
        "feature",
        F.when(fits, F.greatest("area", 1 - F.col("area"))).alias("auc"),
        missing_auc().alias("auc_missing"),
        F.col("n_unique").cast("long").alias("n_unique"),
        (1 - there / F.col("n")).alias("null_share"),
        F.when(continuous, 0.0).otherwise(F.coalesce(F.try_divide("n_unique", there), F.lit(0.0))).alias("cardinality_ratio"),
        F.col("n").cast("long").alias("n"),
    )


def missing_auc() -> Column:
    """From null counts of both classes: half plus half the gap of the null shares; null if hardly any or nearly all are null."""
    p1, p0 = F.try_divide(F.coalesce("null_pos", F.lit(0)), "all_pos"), F.try_divide(F.coalesce("null_neg", F.lit(0)), "all_neg")
    share = (F.coalesce("null_pos", F.lit(0)) + F.coalesce("null_neg", F.lit(0))) / F.col("n")
    return F.when((share > 0) & (share <= 0.999), 0.5 + 0.5 * F.abs(p1 - p0))


def fold(key: Column | str, folds: int, seed: int = 0) -> Column:
    """A fold by hash of the key, the same wherever it is computed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def categorical_scan(frame: DataFrame, names: list[str], label: str, folds: Column, k: int = 5) -> DataFrame:
    """The same as numeric_scan for categories, each scored by the mean of its label outside of its fold.

    Leave-fold-out means are the totals less the fold's own, so no model and no loop over folds.
    """
    rows = long(frame.withColumn("_fold", folds), names, [label, "_fold"], "string")
    hit, miss = F.col(label) == 1, F.col(label) == 0
    parts = [F.struct(F.count_if((F.col("_fold") == i) & hit).alias("pos"), F.count_if((F.col("_fold") == i) & miss).alias("neg")) for i in range(k)]
    # One row for each level, with its counts in every fold; so no feature, however many levels it has, is gathered.
    levels = rows.groupBy("feature", "value").agg(F.array(*parts).alias("folds"), F.count_if(hit).alias("pos"), F.count_if(miss).alias("neg"))
    known = levels.filter("value is not null")
    sums = [F.struct(F.sum(F.col("folds")[i]["pos"]).alias("pos"), F.sum(F.col("folds")[i]["neg"]).alias("neg")) for i in range(k)]
    every = known.groupBy("feature").agg(F.sum("pos").alias("every_pos"), F.sum("neg").alias("every_neg"), F.array(*sums).alias("every_folds"))
    cells = known.join(F.broadcast(every), "feature")  # one row per feature
    pair = F.explode(F.arrays_zip(F.col("folds").alias("own"), F.col("every_folds").alias("all"))).alias("f")
    cells = cells.select("feature", "value", F.col("pos").alias("level_pos"), F.col("neg").alias("level_neg"), "every_pos", "every_neg", pair)
    cells = cells.filter("f.own.pos + f.own.neg > 0")
    out_pos, out_n = F.col("level_pos") - F.col("f.own.pos"), F.col("level_pos") + F.col("level_neg") - F.col("f.own.pos") - F.col("f.own.neg")
    rest_pos, rest_n = F.col("every_pos") - F.col("f.all.pos"), F.col("every_pos") + F.col("every_neg") - F.col("f.all.pos") - F.col("f.all.neg")
    score = F.coalesce(F.try_divide(out_pos, out_n), F.try_divide(rest_pos, rest_n))
    scored = cells.groupBy("feature", score.alias("value")).agg(F.sum("f.own.pos").alias("pos"), F.sum("f.own.neg").alias("neg"))
    ranked = _ranked_auc(scored, ["feature"])
    c, absent = F.col("pos") + F.col("neg"), F.col("value").isNull()
    totals = levels.groupBy("feature").agg(
        F.sum(c).alias("n"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
        F.sum(F.when(absent, F.col("pos"))).alias("null_pos"),
        F.sum(F.when(absent, F.col("neg"))).alias("null_neg"),
        F.count("value").alias("n_unique"),
        F.sum(F.when(~absent, c)).alias("there"),
    )
    out = totals.join(ranked.select("feature", "n_pos", "n_neg", "area"), "feature", "left")
    there = F.coalesce("there", F.lit(0))
    fits = (there >= MINIMUM) & (F.least("n_pos", "n_neg") > 1) & (F.col("n_unique") > 1)
    return out.select(
        "feature",
        F.when(fits, F.greatest("area", 1 - F.col("area"))).alias("auc"),
        missing_auc().alias("auc_missing"),
        F.col("n_unique").cast("long").alias("n_unique"),
        (1 - there / F.col("n")).alias("null_share"),
        F.coalesce(F.try_divide("n_unique", there), F.lit(0.0)).alias("cardinality_ratio"),
        F.col("n").cast("long").alias("n"),
    )


def average_precision(frame: DataFrame, score: str, label: str) -> DataFrame:
    """ap: the sum over thresholds of precision times the step in recall; tied scores are one threshold."""
    counts = frame.groupBy(F.lit(1).alias("_all"), F.col(score).alias("value")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("c"))
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("c").alias("all_c"))
    ranked = below(counts, ["_all"], ["pos", "c"]).join(F.broadcast(totals))  # one row
    precision = (F.col("all_pos") - F.col("below_pos")) / (F.col("all_c") - F.col("below_c"))
    return ranked.agg((F.sum(precision * F.col("pos")) / F.sum("pos")).alias("ap"))


def headline(frame: DataFrame, score: str, label: str) -> DataFrame:
    """n, base_rate, brier, log_loss in one pass."""
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -F.avg(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    brier = F.avg((F.col(score) - F.col(label)) ** 2)
    return frame.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("base_rate"), brier.alias("brier"), loss.alias("log_loss"))


def capture(frame: DataFrame, score: str, label: str, tie: list[str], shares: tuple[int, ...] = SHARES) -> DataFrame:
    """share, k, capture, lift of the highest scores, all shares in one pass; equal scores go by the tie columns."""
    totals = spread(frame, score, F.sum(label).alias("events"))
    n, events = totals["n"], totals["events"] or 0
    if not n:
        return frame.sparkSession.createDataFrame([], "share int, k long, capture double, lift double")
    tops = {share: max(1, n * share // 100) for share in shares}
    placed = positions(frame, score, [label], tie, totals["cuts"])
    found = placed.agg(*[F.sum(F.when(F.col("pos") < k, F.col(label))).alias(f"s{share}") for share, k in tops.items()])
    rows = []
    for share, k in tops.items():
        caught = F.col(f"s{share}")
        capture, lift = F.try_divide(caught, F.lit(events)), F.try_divide(caught / k, F.lit(events / n))
        rows.append(F.struct(F.lit(share).alias("share"), F.lit(k).cast("long").alias("k"), capture.alias("capture"), lift.alias("lift")))
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def edges(frame: DataFrame, value: str, parts: int) -> list[float]:
    """Distinct quantile edges, both ends included."""
    found = quantiles(frame, [], value, [i / parts for i in range(parts + 1)]).first()
    return sorted({x for x in (found["q"] if found else []) if x is not None})


def bucket(value: str, cuts: list[float], right: bool) -> Column:
    """Index of the interval; right: (a, b] with the least edge in the first, else [a, b) with the last edge in the last."""
    inner = cuts[1:-1]
    steps = [(F.col(value) > e) if right else (F.col(value) >= e) for e in inner]
    return functools.reduce(lambda a, b: a + b, [s.cast("int") for s in steps], F.lit(0))


def calibration(frame: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """bin, n, mean_predicted, observed over quantile bins; empty with fewer than three edges."""
    cuts = edges(frame, score, parts)
    rows = frame.withColumn("bin", bucket(score, cuts, False)) if len(cuts) >= 3 else frame.filter(F.lit(False)).withColumn("bin", F.lit(0))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("observed"))


def lift_deciles(frame: DataFrame, score: str, label: str, tie: list[str], parts: int = 10) -> DataFrame:
    """decile (0 the riskiest), n, rate: by position among rows sorted by falling score, ties by the tie columns."""
    about = spread(frame, score)
    part = F.floor(F.col("pos") * parts / F.lit(about["n"])).cast("int")
    return positions(frame, score, [label], tie, about["cuts"] or []).groupBy(part.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))


def numeric_effects(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, low_rate (at or below the 20th percentile), high_rate (at or above the 80th), spread."""
    rows = long(frame, names, [label]).filter("value is not null")
    cuts = quantiles(rows, ["feature"], "value", [0.2, 0.8])
    both = rows.join(F.broadcast(cuts), "feature")  # one row per feature, fewer than columns of the frame
    low, high = F.col("value") <= F.col("q")[0], F.col("value") >= F.col("q")[1]
    rates = [F.avg(F.when(side, F.col(label))).alias(name) for name, side in (("low_rate", low), ("high_rate", high))]
    return both.groupBy("feature").agg(*rates).withColumn("spread", F.col("high_rate") - F.col("low_rate"))


def categorical_effects(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, low_rate, high_rate, spread over levels of at least max(20, 1 %) rows."""
    rows = long(frame, names, [label], "string").filter("value is not null")
    levels = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
    total = Window.partitionBy("feature")
    kept = levels.withColumn("all", F.sum("n").over(total)).filter(F.col("n") >= F.greatest(F.lit(20.0), 0.01 * F.col("all")))
    return kept.groupBy("feature").agg(F.min("rate").alias("low_rate"), F.max("rate").alias("high_rate")).withColumn("spread", F.col("high_rate") - F.col("low_rate"))


def profile(frame: DataFrame, name: str, label: str, kind: str = "numeric", parts: int = 10, least: int = 20) -> DataFrame:
    """feature, bucket, n, rate by decile of a number or by level of a category."""
    value = F.col(f"`{name}`")
    if kind == "numeric":
        cuts = edges(frame, f"`{name}`", parts)
        rows = frame.filter(value.isNotNull()).withColumn("bucket", bucket(f"`{name}`", cuts, True).cast("string"))
        least = 1
    else:
        rows = frame.filter(value.isNotNull()).withColumn("bucket", value.cast("string"))
    return rows.groupBy(F.lit(name).alias("feature"), "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")).filter(F.col("n") >= least)


def smd(frame: DataFrame, names: list[str], treated: str, weight: str | None = None) -> DataFrame:
    """feature, smd: the gap of (weighted) arm means over the root of the mean of the arms' plain variances."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = long(frame.withColumn("_w", w), names, [treated, "_w"])
    arms = {}
    for arm in (0, 1):
        on = (F.col(treated) == arm) & F.col("value").isNotNull()
        arms[arm] = (F.try_divide(F.sum(F.when(on, F.col("value") * F.col("_w"))), F.sum(F.when(on, F.col("_w")))), F.var_pop(F.when(on, F.col("value"))))
    gap = arms[1][0] - arms[0][0]
    return rows.groupBy("feature").agg(F.try_divide(F.abs(gap), F.sqrt((arms[1][1] + arms[0][1]) / 2)).alias("smd"))
