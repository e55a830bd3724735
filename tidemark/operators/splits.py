"""Train and test sides, and folds, as columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from ..plans.panel import AT, ID


@dataclass
class Split:
    frame: DataFrame  # with `split`: train, test or purged
    cutoff: dt.date | None
    strategy: str
    notes: list[str]


def test_dates(dates: list[dt.date], fraction: float) -> int:
    """How many of the last dates are held out: at least one, and not all."""
    return min(max(round(len(dates) * fraction), 1), len(dates) - 1)


def side(cutoff: dt.date, horizon: int, purge: int) -> Column:
    """Rows before the cutoff whose outcome is known by then train; those in between are purged."""
    train = (F.col(AT) < F.date_sub(F.lit(cutoff), purge)) & (F.col(AT) <= F.date_sub(F.lit(cutoff), horizon))
    return F.when(F.col(AT) >= F.lit(cutoff), "test").when(train, "train").otherwise("purged")


def out_of_time(frame: DataFrame, dates: list[dt.date], fraction: float, horizon: int, purge: int = 0) -> Split:
    dates = sorted(dates)
    cutoff = dates[len(dates) - test_dates(dates, fraction)]
    return Split(frame.withColumn("split", side(cutoff, horizon, purge)), cutoff, "out_of_time", [])


def entity_folds(frame: DataFrame, folds: int, seed: int = 42, key: Column | None = None, strata: tuple[str, ...] = ("label",)) -> DataFrame:
    """entity_id, fold: entities dealt evenly over the folds within each kind, a kind being which of the strata (0 or 1) an entity ever had.

    Dealt by rank of a hash within the kind. Ranks come from counts of hash buckets and a rank inside
    each bucket, so no task sorts all entities.
    """
    people = frame.groupBy(ID).agg(F.struct(*[F.max(c).alias(f"s{i}") for i, c in enumerate(strata)]).alias("ever"))
    order = key if key is not None else F.xxhash64(ID, F.lit(seed))
    bucket = F.shiftright(F.xxhash64("_o"), 54).cast("int") if key is None else F.lit(0)
    people = people.withColumn("_o", order).withColumn("_b", bucket)
    sizes = people.groupBy("ever", "_b").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("ever").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    number = F.row_number().over(Window.partitionBy("ever", "_b").orderBy("_o", ID)) - 1
    ranked = people.withColumn("_n", number).join(F.broadcast(before), ["ever", "_b"])  # at most kinds x 1024 rows
    return ranked.select(ID, ((F.col("_n") + F.col("before")) % folds).cast("int").alias("fold"))


def grouped_random(frame: DataFrame, fraction: float, seed: int = 42) -> Split:
    folds = entity_folds(frame, max(2, round(1 / fraction)), seed)
    out = frame.join(folds, ID).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")
    return Split(out, None, "grouped_random", [])


def make(frame: DataFrame, dates: list[dt.date], options: dict, horizon: int, seed: int = 42) -> Split:
    fraction = float(options["test_fraction"])
    if options["strategy"] == "out_of_time" and len(set(dates)) > 1:
        return out_of_time(frame, sorted(set(dates)), fraction, horizon, int(options["purge_days"] or 0))
    return grouped_random(frame, fraction, seed)


def sizes(frame: DataFrame) -> DataFrame:
    return frame.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("events"))


def checked(split: Split) -> Split:
    by = {r["split"]: r for r in sizes(split.frame).collect()}
    for name in ("train", "test"):
        if name not in by:
            raise InsufficientDataError(f"the {name} side of the split is empty")
        if not by[name]["events"]:
            raise InsufficientDataError(f"the {name} side of the split has no events")
        if by[name]["events"] < 25:
            split.notes.append(f"the {name} side has only {by[name]['events']} events")
    return split


def spanning(frame: DataFrame) -> DataFrame:
    """n_test, n_both: entities of the test side, and how many of them train too."""
    kinds = frame.filter("split in ('train', 'test')").groupBy(ID).agg(F.max(F.col("split") == "test").alias("t"), F.max(F.col("split") == "train").alias("r"))
    return kinds.agg(F.count_if("t").alias("n_test"), F.count_if(F.col("t") & F.col("r")).alias("n_both"))
