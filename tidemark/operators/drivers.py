"""What drives the score: Shapley values or permutation importance, direction, effect, stability."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.panel import AT, ID
from . import metrics, modeling, shap
from .features import Meta

TOP_PROFILES = 10


def _paired(frame: DataFrame, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """frame with `_o`, another row of it: the same rows in an order drawn by a hash.

    Rows pair within buckets of a hash, by two orders of each bucket; so no task sorts all rows.
    """
    buckets = max(1, frame.count() // 20_000)
    part = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit("bucket")), F.lit(buckets))
    by = Window.partitionBy("_b")
    numbered = frame.withColumn("_b", part).withColumn("_n", F.row_number().over(by.orderBy(*keys)))
    other = numbered.select("_b", F.row_number().over(by.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)).alias("_n"), F.struct(*[f"`{c}`" for c in frame.columns]).alias("_o"))
    return numbered.join(other, ["_b", "_n"])


def shuffled(frame: DataFrame, name: str, seed: int, keys: tuple[str, ...] = (ID, AT)) -> DataFrame:
    """frame with the values of one column dealt to other rows."""
    return _paired(frame, seed, keys).withColumn(name, F.col(f"_o.`{name}`")).select(*frame.columns)


def variants(frame: DataFrame, names: list[str], seed: int, keys: tuple[str, ...] = (ID, AT)) -> DataFrame:
    """frame as it is (tag null) and once for each name with that column shuffled (tag its name)."""

    def row(tag: str | None):
        return F.struct(F.lit(tag).cast("string").alias("tag"), *[F.col(f"_o.`{c}`" if c == tag else f"`{c}`").alias(c) for c in frame.columns])

    return _paired(frame, seed, keys).select(F.explode(F.array(*map(row, [None, *names]))).alias("v")).select("v.*")


def permutation(model: PipelineModel, frame: DataFrame, meta: dict[str, Meta], repeats: int, seed: int) -> dict[str, float]:
    """Mean loss of area under the curve with each feature shuffled, never below 0; one pass for each repeat."""
    frame = frame.select(ID, AT, "label", *[f"`{n}`" for n in meta]).cache()
    losses: dict[str, list[float]] = {n: [] for n in meta}
    for r in range(repeats):
        scored = modeling.score_tree(model, variants(frame, list(meta), seed + 101 * r), meta)
        areas = {x["tag"]: x["area"] for x in metrics.auc(scored.withColumn("tag", F.coalesce("tag", F.lit(""))), "score", "label", ["tag"]).collect()}
        for n in meta:
            losses[n].append((areas.get("") or 0.5) - (areas.get(n) or 0.5))
    frame.unpersist()
    return {n: max(0.0, sum(x) / len(x)) if x else 0.0 for n, x in losses.items()}


def importances(method: str, model: PipelineModel, frame: DataFrame, meta: dict[str, Meta], repeats: int, seed: int) -> tuple[dict[str, float], str]:
    """Importance of each feature, and what it is: Shapley values unless method is permutation."""
    if method == "permutation":
        return permutation(model, frame, meta, repeats, seed), "loss of area under the curve with the feature shuffled"
    return shap.importance(model, frame, meta, seed=seed), "mean absolute Shapley value on the held-out side"


def direction(frame: DataFrame, meta: dict[str, Meta]) -> DataFrame:
    """feature, direction: whether large values go with the event; for numbers."""
    numeric = [n for n, m in meta.items() if m.kind == "numeric"]
    rows = metrics.long(frame, numeric, ["label"])
    return metrics.auc(rows, "value", "label", ["feature"]).select("feature", F.when(F.col("area") > 0.5, "raises risk").when(F.col("area") < 0.5, "lowers risk").otherwise("none").alias("direction"))


def effects(frame: DataFrame, meta: dict[str, Meta]) -> DataFrame:
    numeric, other = [n for n, m in meta.items() if m.kind == "numeric"], [n for n, m in meta.items() if m.kind != "numeric"]
    parts = ([metrics.numeric_effects(frame, numeric, "label")] if numeric else []) + ([metrics.categorical_effects(frame, other, "label")] if other else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stability(train: DataFrame, meta: dict[str, Meta], options: dict, folds: int, seed: int, top_k: int, repeats: int = 3) -> dict[str, float]:
    """Share of folds in which a feature is among the top k by permutation on the fold left out."""
    dealt = modeling.folds_of(train, folds, seed).cache()
    seen = dict.fromkeys(meta, 0)
    for k in range(folds):
        model = modeling.fit_tree(dealt.filter(F.col("fold") != k), meta, options, seed)
        found = permutation(model, dealt.filter(F.col("fold") == k), meta, repeats, seed + k)
        for name in sorted(found, key=lambda n: (-found[n], n))[:top_k]:
            seen[name] += found[name] > 0
    dealt.unpersist()
    return {n: c / folds for n, c in seen.items()}


def table(importance: dict[str, float], test: DataFrame, meta: dict[str, Meta], stable: dict[str, float], least: float) -> DataFrame:
    """rank, feature, importance, direction, low_rate, high_rate, spread, stability, stable: joined by feature."""
    spark = test.sparkSession
    base = spark.createDataFrame([(n, float(v), float(stable.get(n, 0.0)), stable.get(n, 0.0) >= least) for n, v in importance.items()], "feature string, importance double, stability double, stable boolean")
    out = base.join(direction(test, meta), "feature", "left").join(effects(test, meta), "feature", "left")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def profiles(frame: DataFrame, meta: dict[str, Meta], names: list[str]) -> DataFrame | None:
    """Event rate by decile or category of the foremost drivers."""
    parts = [metrics.profile(frame, n, "label", meta[n].kind) for n in names[:TOP_PROFILES]]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
