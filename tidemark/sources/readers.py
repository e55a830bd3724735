"""Tables in: files, required columns, dates, entities and event logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..plans.spec import Log, Spec


@dataclass
class Dataset:
    entity: DataFrame
    events: dict[str, DataFrame]
    notes: list[str] = field(default_factory=list)


def read(spark: SparkSession, path: str, kind: str = "auto", text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Parquet by its name or kind, else CSV with a header. Ids named in text_columns stay text, so 00123 keeps its zeros."""
    if kind == "parquet" or (kind == "auto" and path.rstrip("/").endswith((".parquet", ".pq"))):
        return spark.read.parquet(path)
    plain = spark.read.option("header", True)
    df = plain.option("inferSchema", True).csv(path)
    wanted = [c for c in text_columns if c in df.columns]
    if not wanted:
        return df
    types = ", ".join(f"`{n}` {'string' if n in wanted else t}" for n, t in df.dtypes)
    return plain.schema(types).csv(path)


def require(df: DataFrame, columns: list[str], where: str) -> None:
    if missing := [c for c in columns if c and c not in df.columns]:
        raise DataError(f"{where}: there is no column {missing}; there are {df.columns}")


def as_day(c: Column | str) -> Column:
    """The day of a date, timestamp or text; null where it cannot be read."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("timestamp_ntz").cast("date")


def unread(raw: Column, day: Column) -> Column:
    """How many values are there but are no dates."""
    return F.count_if(raw.isNotNull() & day.isNull())


def entities(df: DataFrame, spec: Spec, notes: list[str] | None = None, check: bool = True) -> DataFrame:
    """Dates as days, rows without a start dropped, an end before the start taken back."""
    notes = notes if notes is not None else []
    ends = [spec.event_column] if spec.target_mode == "event_date" else []
    require(df, [spec.id_column, spec.start_column, *ends, *([spec.label_column] if spec.target_mode == "label" else [])], "entity table")
    dates = [c for c in (spec.start_column, *ends, spec.valid_from, spec.valid_to) if c and c in df.columns]
    out = df.withColumns({c: as_day(c) for c in dates})
    if check:
        tests = {f"bad:{c}": unread(F.col(c), as_day(c)) for c in dates}
        row = df.agg(*[t.alias(n) for n, t in tests.items()]).first()
        notes += [f"{row[f'bad:{c}']} values of {c} are no dates" for c in dates if row[f"bad:{c}"]]
        if not spec.valid_from:
            twice = duplicates(df, spec.id_column)
            if (n := twice.count()) > 0:
                raise DataError(f"entity table: {n} ids have several rows; name valid_from_column if these are versions")
    out = out.filter(F.col(spec.start_column).isNotNull())
    for end in ends:
        out = out.withColumn(end, F.when(F.col(end) >= F.col(spec.start_column), F.col(end)))
    return out


def duplicates(df: DataFrame, id_column: str) -> DataFrame:
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def current(entity: DataFrame, spec: Spec) -> DataFrame:
    """One row per id: of versions, the latest."""
    if not spec.valid_from or spec.valid_from not in entity.columns:
        return entity
    rest = [c for c in entity.columns if c != spec.id_column]
    latest = entity.groupBy(spec.id_column).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(spec.valid_from), F.lit("0001-01-01").cast("date"))).alias("v"))
    return latest.select(spec.id_column, "v.*").select(*entity.columns)


def events(df: DataFrame, log: Log, id_column: str) -> DataFrame:
    """The log with its date as a day in `date_column` and its id under the entity's name; undated rows go."""
    require(df, [log.id_column, log.date_column], f"event log {log.name}")
    out = df.withColumn(log.date_column, as_day(log.date_column)).filter(F.col(log.date_column).isNotNull())
    return out.withColumnRenamed(log.id_column, id_column) if log.id_column != id_column else out


def orphans(log: DataFrame, entity: DataFrame, id_column: str) -> DataFrame:
    """Events of ids that the entity table lacks."""
    return log.join(entity.select(id_column), id_column, "left_anti")


def dataset(spark: SparkSession, spec: Spec, check: bool = True, tables: dict[str, DataFrame] | None = None) -> Dataset:
    notes: list[str] = list(spec.notes)
    given = tables or {}
    entity = given["entity"] if "entity" in given else read(spark, spec.entity_path, spec.entity_format, (spec.id_column,))
    entity = entities(entity, spec, notes, check)
    logs = {}
    for log in spec.logs.values():
        raw = given[log.name] if log.name in given else read(spark, log.path, log.format, (log.id_column,))
        logs[log.name] = events(raw, log, spec.id_column)
        if check:
            strays = orphans(logs[log.name], entity, spec.id_column).count()
            if strays:
                notes.append(f"event log {log.name}: {strays} events belong to no entity")
    return Dataset(entity, logs, notes)
