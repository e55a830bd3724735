"""Boosted trees, a logistic baseline, calibration, and honest metrics, on MLlib."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.panel import AT, ID
from . import metrics, splits
from .features import Meta

#: Stands for a missing number beside its indicator; trees here take no NaN.
MISSING = -1e9
#: Stands for a missing category.
ABSENT = "__missing__"
RARE = 20
#: So many levels of a category at most are told apart by trees, and by the logistic baseline.
TREE_LEVELS = 200
LINEAR_LEVELS = 1000


@dataclass
class Fitted:
    model: PipelineModel
    calibrator: object | None
    scored: DataFrame
    metrics: dict
    baseline: dict
    cv: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def weighted(frame: DataFrame, class_weight: str | None, label: str = "label") -> DataFrame:
    """frame with weight: n / (classes * n_class) if class_weight is balanced, else 1."""
    if not class_weight:
        return frame.withColumn("weight", F.lit(1.0))
    counts = {r[label]: r["n"] for r in frame.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight = functools.reduce(lambda c, kv: c.when(F.col(label) == kv[0], n / (len(counts) * kv[1])), counts.items(), F.when(F.lit(False), 0.0))
    return frame.withColumn("weight", weight)


def split_names(meta: dict[str, Meta]) -> tuple[list[str], list[str]]:
    return [n for n, m in meta.items() if m.kind == "numeric"], [n for n, m in meta.items() if m.kind != "numeric"]


def common_levels(frame: DataFrame, categorical: list[str], least: int, most: int) -> dict[str, list[str]]:
    """Of each category the `most` commonest levels of at least `least` rows, missing being a level; one job for all."""
    if not categorical:
        return {}
    filled = frame.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(ABSENT)).alias(c) for c in categorical])
    sizes = metrics.long(filled, categorical, [], "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("n").desc(), "value"))
    rows = sizes.withColumn("place", place).filter(F.col("place") <= most).collect()  # at most features x most rows
    out: dict[str, list[str]] = {c: [] for c in categorical}
    for r in rows:
        out[r["feature"]].append(r["value"])
    return out


def categories(categorical: list[str], levels: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Texts of categories, missing as a level of its own. Levels that are not listed are null, which an indexer that has not seen them keeps as one more level."""
    out = {}
    for c in categorical:
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(ABSENT))
        out[c] = value if levels is None else F.when(value.isin(levels[c]), value)
    return out


def tree_inputs(frame: DataFrame, numeric: list[str], categorical: list[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Missing numbers as a far value with an indicator, missing categories as a level of their own."""
    out = {f"{n}__there": F.col(f"`{n}`").isNotNull().cast("double") for n in numeric}
    out |= {n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(MISSING)) for n in numeric}
    return frame.withColumns(out | categories(categorical, levels))


def tree_pipeline(numeric: list[str], categorical: list[str], options: dict, seed: int, frame_levels: int = 32) -> Pipeline:
    indexed = [f"{c}__index" for c in categorical]
    stages = [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep")] if categorical else []
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{n}__there" for n in numeric), *indexed], outputCol="inputs"))
    trees = GBTClassifier(
        featuresCol="inputs",
        labelCol="label",
        weightCol="weight",
        maxIter=int(options["max_iter"]),
        stepSize=float(options["learning_rate"]),
        maxDepth=max(2, min(8, int(options["max_leaf_nodes"]).bit_length())),
        maxBins=max(64, frame_levels),
        seed=seed,
        validationIndicatorCol="held",
        validationTol=0.001,
    )
    return Pipeline(stages=[*stages, trees])


def linear_pipeline(numeric: list[str], categorical: list[str]) -> Pipeline:
    stages, inputs = [], []
    if numeric:
        filled = [f"{n}__filled" for n in numeric]
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled))
        stages.append(VectorAssembler(inputCols=filled, outputCol="numbers"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True))
        inputs.append("scaled")
    if categorical:
        indexed, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="inputs"))
    stages.append(LogisticRegression(featuresCol="inputs", labelCol="label", weightCol="weight", maxIter=100, regParam=0.01))
    return Pipeline(stages=stages)


def positive(model: PipelineModel, frame: DataFrame, name: str = "score") -> DataFrame:
    out = model.transform(frame).withColumn(name, vector_to_array("probability")[1])
    return out.select(*frame.columns, name)


def fit_tree(train: DataFrame, meta: dict[str, Meta], options: dict, seed: int) -> PipelineModel:
    """Boosted trees; classes weigh as options' class_weight says (balanced, or none)."""
    numeric, categorical = split_names(meta)
    levels = common_levels(train, categorical, 1, TREE_LEVELS)
    ready = tree_inputs(weighted(train, options.get("class_weight")), numeric, categorical, levels)
    # A share of entities is kept out for early stopping.
    ready = ready.withColumn("held", metrics.fold(ID, 20, seed + 7) < 3)
    return tree_pipeline(numeric, categorical, options, seed, max(map(len, levels.values()), default=0) + 2).fit(ready)


def score_tree(model: PipelineModel, frame: DataFrame, meta: dict[str, Meta], name: str = "score") -> DataFrame:
    numeric, categorical = split_names(meta)
    keyed = frame.withColumn("_row", F.struct(*[f"`{c}`" for c in frame.columns]))
    ready = tree_inputs(keyed, numeric, categorical)
    return positive(model, ready, name).select("_row.*", name)


def fit_linear(train: DataFrame, meta: dict[str, Meta], options: dict) -> tuple[PipelineModel, list[str]]:
    """A logistic model; levels of fewer than RARE rows are one level, classes weigh as in fit_tree."""
    numeric, categorical = split_names(meta)
    there = train.agg(*[F.count(f"`{n}`").alias(n) for n in numeric]).first() if numeric else {}
    usable = [n for n in numeric if there[n]]
    levels = {c: x for c, x in common_levels(train, categorical, RARE, LINEAR_LEVELS).items() if x}
    categorical = list(levels)
    ready = weighted(train, options.get("class_weight")).withColumns(categories(categorical, levels))
    return linear_pipeline(usable, categorical).fit(ready), usable


def score_linear(model: PipelineModel, frame: DataFrame, meta: dict[str, Meta], name: str = "baseline") -> DataFrame:
    _, categorical = split_names(meta)
    return positive(model, frame.withColumns(categories(categorical)), name)


def folds_of(frame: DataFrame, folds: int, seed: int, strata: tuple[str, ...] = ("label",)) -> DataFrame:
    return frame.join(splits.entity_folds(frame, folds, seed, strata=strata), ID)


def out_of_fold(train: DataFrame, meta: dict[str, Meta], options: dict, folds: int, seed: int) -> DataFrame:
    """train with fold and score, each row scored by a model that never saw its entity."""
    dealt = folds_of(train, folds, seed)
    parts = [score_tree(fit_tree(dealt.filter(F.col("fold") != k), meta, options, seed), dealt.filter(F.col("fold") == k), meta) for k in range(folds)]
    return functools.reduce(DataFrame.unionByName, parts)


def calibrate(scored: DataFrame):
    """One isotonic curve on out-of-fold scores."""
    return IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(scored.select("score", F.col("label").cast("double").alias("label")))


def apply_curve(model, score: Column) -> Column:
    """The isotonic curve as nested conditions over its bounds, so it stays an expression."""
    xs, ys = model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()

    def between(low: int, high: int) -> Column:
        if high - low == 1:
            slope = 0.0 if xs[high] == xs[low] else (ys[high] - ys[low]) / (xs[high] - xs[low])
            return F.lit(ys[low]) + (score - xs[low]) * slope
        middle = (low + high) // 2
        return F.when(score < xs[middle], between(low, middle)).otherwise(between(middle, high))

    if len(xs) < 2:
        return F.lit(ys[0] if ys else None)
    return F.when(score <= xs[0], ys[0]).when(score >= xs[-1], ys[-1]).otherwise(between(0, len(xs) - 1))


def evaluate(frame: DataFrame, score: str = "score", label: str = "label", tie: tuple[str, ...] = (ID, AT)) -> dict:
    out = metrics.headline(frame, score, label).first().asDict()
    out["auc"] = metrics.auc(frame, score, label).first()
    out["auc"] = out["auc"]["area"] if out["auc"] else None
    out["average_precision"] = metrics.average_precision(frame, score, label).first()["ap"]
    for r in metrics.capture(frame, score, label, list(tie)).collect():
        out[f"capture_at_{r['share']}"], out[f"lift_at_{r['share']}"] = r["capture"], r["lift"]
    return out


def fit(train: DataFrame, test: DataFrame, meta: dict[str, Meta], options: dict, folds: int, seed: int) -> Fitted:
    notes: list[str] = []
    model = fit_tree(train, meta, options, seed)
    scored, curve, cv = score_tree(model, test, meta), None, []
    inside = out_of_fold(train, meta, options, folds, seed).cache()
    for k in range(folds):
        part = inside.filter(F.col("fold") == k)
        cv.append({"fold": k} | evaluate(part))
    if options["calibrate"]:
        curve = calibrate(inside)
        scored = scored.withColumn("raw_score", F.col("score")).withColumn("score", apply_curve(curve, F.col("raw_score")))
    inside.unpersist()
    linear, _ = fit_linear(train, meta, options)
    scored = score_linear(linear, scored, meta).cache()
    own, base = evaluate(scored), evaluate(scored, "baseline")
    if own["auc"] is not None and base["auc"] is not None and own["auc"] - base["auc"] < 0.01:
        notes.append("the trees barely beat the logistic baseline")
    return Fitted(model, curve, scored, own, base, cv, notes)
