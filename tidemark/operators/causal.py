"""Effects of a treatment on the outcome, doubly robust, with checks that try to refute them."""

from __future__ import annotations

import fnmatch
import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.special import normal_two_sided
from ..plans.panel import AT, ID
from . import drivers, metrics, modeling
from .features import Features, Meta, segments

CONFOUNDERS = 80
LEAST_SUPPORT = 50


@dataclass
class Effect:
    treatment: str
    n: int = 0
    share_treated: float = 0.0
    naive: float | None = None
    ate: float | None = None
    se: float | None = None
    ci: tuple[float, float] | None = None
    p_value: float | None = None
    overlap: float | None = None
    max_smd: float | None = None
    valid: bool = False
    verdict: str = ""
    refutations: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def binarise(frame: DataFrame, feature: str, kind: str = "binary", threshold: float = 0.0, direction: str = "greater") -> Column:
    """1 if treated, else 0; a missing value is not treated."""
    x = F.col(f"`{feature}`")
    if kind == "threshold":
        hit = x > threshold if direction == "greater" else x < threshold
    elif kind == "binary":
        hit = x > 0
    elif kind == "continuous_median_split":
        middle = metrics.quantiles(frame, [], f"`{feature}`", [0.5]).first()
        hit = x > F.lit(middle["q"][0] if middle else None)
    else:
        raise ConfigError(f"causal.yaml: treatment type {kind!r} is not threshold, binary or continuous_median_split")
    return F.coalesce(hit, F.lit(False)).cast("int")


def root(name: str) -> str:
    """A feature's name without its aggregate, for finding siblings of one column."""
    return "__".join(segments(name)[:-1]) if len(segments(name)) > 2 else name


def confounders(features: Features, treatment: str, options: dict) -> list[str]:
    """Explicit ones, or all but the treatment, its siblings, its heirs and excluded names.

    The count of a subset of events has its whole group as sibling: every column of it is about the same events.
    """
    if options.get("mode") == "explicit":
        return [n for n in options.get("explicit") or [] if n in features.meta and n != treatment]
    barred = {treatment} | features.dependents({treatment}) | set(features.meta[treatment].depends_on)
    meta = features.meta[treatment]
    parts = segments(treatment)
    whole = parts[-1].startswith(("event_count", "recency_days")) and meta.window_days is not None
    for n, m in features.meta.items():
        if m.group == meta.group and (whole or root(n) == root(treatment)) and meta.source != "entity":
            barred.add(n)
        if meta.source != "entity" and len(parts) > 2 and m.group == meta.group and len(segments(n)) > 2 and segments(n)[-2] == parts[-2]:
            barred.add(n)
    barred |= features.dependents(barred)
    for pattern in options.get("exclude") or []:
        barred |= {n for n in features.meta if fnmatch.fnmatch(n, pattern)}
    return [n for n in features.meta if n not in barred]


def naive_difference(frame: DataFrame, treated: str = "treated", label: str = "label") -> DataFrame:
    return frame.agg((F.avg(F.when(F.col(treated) == 1, F.col(label))) - F.avg(F.when(F.col(treated) == 0, F.col(label)))).alias("naive_diff"))


def scores(e: Column, m1: Column, m0: Column, treated: Column, label: Column) -> Column:
    """The doubly robust contribution of each row."""
    return m1 - m0 + treated * (label - m1) / e - (1 - treated) * (label - m0) / (1 - e)


def estimate(frame: DataFrame, clip: float = 0.02, treated: str = "treated", label: str = "label", bootstrap: int = 0, seed: int = 42, keys: tuple[str, ...] = (ID, AT)) -> dict:
    """frame: treated, label, e (propensity), m1, m0. n, ate, se, ci, p_value, overlap over the rows within support."""
    total = frame.count()
    inside = frame.filter((F.col("e") > clip * 1.5) & (F.col("e") < 1 - clip * 1.5))
    psi = scores(F.col("e"), F.col("m1"), F.col("m0"), F.col(treated), F.col(label))
    rows = inside.withColumn("psi", psi)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("psi").alias("ate"), F.stddev_samp("psi").alias("s")).first()
    if r["n"] < LEAST_SUPPORT:
        return {"n": r["n"], "overlap": r["n"] / total if total else 0.0, "valid": False}
    se = (r["s"] or 0.0) / math.sqrt(r["n"])
    ci = (r["ate"] - 1.96 * se, r["ate"] + 1.96 * se)
    if bootstrap:
        # Poisson weights by the inverse distribution of a hash; all replicates in one pass.
        cdf = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]

        def weight(b: int) -> Column:
            u = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(b)), F.lit(1 << 30)) / (1 << 30)
            return sum(((u > c).cast("int") for c in cdf), F.lit(0))

        reps = rows.agg(*[(F.sum(weight(b) * F.col("psi")) / F.sum(weight(b))).alias(f"b{b}") for b in range(bootstrap)]).first()
        means = sorted(x for x in reps if x is not None)
        ci = (means[int(0.025 * (len(means) - 1))], means[math.ceil(0.975 * (len(means) - 1))])
    return {"n": r["n"], "ate": r["ate"], "se": se, "ci": ci, "p_value": normal_two_sided(r["ate"] / se) if se > 0 else 1.0, "overlap": r["n"] / total, "valid": True}


def fold_count(frame: DataFrame, folds: int) -> int:
    """No more folds than the rarer side of treatment or outcome has rows, and at least two."""
    kinds = frame.agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in ("treated", "label") for v in (0, 1)]).first()
    return max(2, min(folds, *kinds))


def nuisances(frame: DataFrame, meta: dict[str, Meta], options: dict, folds: int, seed: int, clip: float = 0.02) -> DataFrame:
    """frame with e, m1, m0 for each row: chances, so classes are not weighed, from models fitted without its entity's fold.

    Folds are even in treatment and outcome.
    """
    folds = fold_count(frame, folds)
    plain = options | {"class_weight": None}
    dealt = modeling.folds_of(frame, folds, seed, ("treated", "label")).cache()
    parts = []
    for k in range(folds):
        rest, part = dealt.filter(F.col("fold") != k), dealt.filter(F.col("fold") == k)
        part = _chances(rest.withColumn("label", F.col("treated")), part, meta, plain, seed, "e")
        for arm in (1, 0):
            part = _chances(rest.filter(F.col("treated") == arm), part, meta, plain, seed, f"m{arm}")
        parts.append(part)
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumn("e", F.least(F.greatest("e", F.lit(clip)), F.lit(1 - clip)))


def _chances(train: DataFrame, frame: DataFrame, meta: dict[str, Meta], options: dict, seed: int, name: str) -> DataFrame:
    """frame with the chance of label 1 by a model of train; its mean where train has one label only."""
    known = train.agg(F.avg("label").alias("mean"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if known["low"] == known["high"]:
        return frame.withColumn(name, F.lit(float(known["mean"] or 0.0)))
    return modeling.score_tree(modeling.fit_tree(train, meta, options, seed), frame, meta, name)


def culprit(frame: DataFrame, numeric: list[str], least: int = LEAST_SUPPORT) -> tuple[str, float] | None:
    """The number that alone tells the treated best, and its area under the curve in the better direction."""
    if not numeric:
        return None
    areas = metrics.auc(metrics.long(frame, numeric, ["treated"]), "value", "treated", ["feature"])
    found = areas.filter((F.col("n_pos") + F.col("n_neg") >= least) & F.col("area").isNotNull()).select("feature", F.greatest("area", 1 - F.col("area")).alias("area"))
    best = found.orderBy(F.col("area").desc(), "feature").first()
    return (best["feature"], best["area"]) if best else None


def verdict(effect: Effect, least: float) -> str:
    if not effect.valid:
        return "not estimable"
    if effect.overlap is not None and effect.overlap < least:
        return "weak overlap"
    if any(not r["passed"] for r in effect.refutations):
        return "refuted"
    if effect.ci and effect.ci[0] <= 0 <= effect.ci[1]:
        return "no detectable effect"
    return "raises risk" if effect.ate > 0 else "lowers risk"


def run(features: Features, treatment: dict, options: dict, model_options: dict, seed: int = 42) -> Effect:
    name, column = treatment.get("name") or treatment["feature"], treatment["feature"]
    out = Effect(name)
    if column not in features.meta:
        out.verdict = "skipped"
        out.notes.append(f"{column} is not a feature, or is quarantined")
        return out
    estimator, refute = options.get("estimator") or {}, options.get("refutations") or {}
    clip, folds = float(estimator.get("propensity_clip", 0.02)), int(estimator.get("cross_fit_folds", 5))
    names = confounders(features, column, options.get("confounders") or {})
    frame = features.frame.withColumn("treated", binarise(features.frame, column, treatment.get("type", "binary"), float(treatment.get("threshold", 0) or 0), treatment.get("direction", "greater")))
    frame = frame.select(ID, AT, "label", "treated", *[f"`{n}`" for n in names]).cache()
    share = frame.agg(F.avg("treated").alias("s")).first()["s"] or 0.0
    out.share_treated = share
    if not 0.01 <= share <= 0.99:
        out.verdict = "not estimable"
        out.notes.append(f"{share:.1%} are treated")
        return out
    meta = {n: features.meta[n] for n in names}
    if not meta:
        out.verdict = "not estimable"
        out.notes.append("no confounder is left to adjust for")
        return out
    out.naive = naive_difference(frame).first()["naive_diff"]
    fitted = nuisances(frame, meta, model_options, folds, seed, clip).cache()
    found = estimate(fitted, clip, bootstrap=int(estimator.get("bootstrap") or 0), seed=seed)
    for key in ("n", "ate", "se", "ci", "p_value", "overlap", "valid"):
        setattr(out, key, found.get(key, getattr(out, key)))
    numeric = [n for n, m in meta.items() if m.kind == "numeric"][:CONFOUNDERS]
    if numeric:
        weighted = fitted.withColumn("_ipw", F.col("treated") / F.col("e") + (1 - F.col("treated")) / (1 - F.col("e")))
        out.max_smd = weighted.transform(lambda d: metrics.smd(d, numeric, "treated", "_ipw")).agg(F.max("smd").alias("s")).first()["s"]
    least = float(estimator.get("min_overlap_share", 0.9))
    if (out.overlap or 0) < least:
        out.notes.append(f"only {out.overlap or 0:.1%} of rows have a counterpart in the other arm")
    e_auc = metrics.auc(fitted, "e", "treated").first()
    if e_auc and (e_auc["area"] or 0) >= 0.95:
        best = culprit(fitted, [n for n, m in meta.items() if m.kind == "numeric"])
        named = f", {best[0]} most of all (alone: {best[1]:.3f})" if best else ""
        out.notes.append(f"treatment is nearly determined by the confounders (area {e_auc['area']:.3f}){named}; a mirror of it may be among them")
        out.valid = out.valid and (out.overlap or 0) >= 0.5
    if out.valid and refute.get("placebo_treatment", True):
        fake = nuisances(drivers.shuffled(frame, "treated", seed + 1), meta, model_options, folds, seed, clip)
        placebo = estimate(fake, clip)
        passed = bool(placebo["valid"] and (abs(placebo["ate"]) < abs(out.ate) / 2 or placebo["ci"][0] <= 0 <= placebo["ci"][1]))
        out.refutations.append({"check": "placebo_treatment", "estimate": placebo.get("ate"), "passed": passed})
    if out.valid and refute.get("random_subset", True):
        part = float(refute.get("subset_fraction", 0.7))
        some = frame.filter(F.pmod(F.xxhash64(ID, F.lit(seed + 2)), F.lit(1000)) < int(1000 * part))
        again = estimate(nuisances(some, meta, model_options, folds, seed, clip), clip)
        passed = bool(again["valid"] and abs(again["ate"] - out.ate) <= max(2.5 * again["se"], 0.5 * abs(out.ate)))
        out.refutations.append({"check": "random_subset", "estimate": again.get("ate"), "passed": passed})
    fitted.unpersist()
    frame.unpersist()
    out.verdict = verdict(out, least)
    return out


def stratified(frame: DataFrame, stratum: list[str], treated: str = "treated", label: str = "label") -> DataFrame:
    """frame with e, m1, m0 as the means of each stratum: nuisances without a model."""
    arm = lambda a: F.avg(F.when(F.col(treated) == a, F.col(label)))
    cells = frame.groupBy(*stratum).agg(F.avg(treated).alias("e"), F.coalesce(arm(1), F.lit(0.0)).alias("m1"), F.coalesce(arm(0), F.lit(0.0)).alias("m0"))
    return frame.join(cells, stratum)
