"""What the operators share: keys of rows, tables that cut lineage, and batches for Python."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Stands for a null doc_id inside a key; a row's key also holds a hash of its text.
NO_ID = -(2**63)


def text_of(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with k1 and k2, which tell rows apart and are never null.

    Rows that agree in doc_id and text share their key. Every operator then gives them equal
    results, so it does not matter which of them a joined row came from. Other columns, whatever
    their names, are left behind here and cannot clash.
    """
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"),
        F.xxhash64(text).alias("k2"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one the session was given since.

    Where there is neither, a session with a local master, as in tests, gets a folder of its own.
    On a cluster that would be one machine's disk, so it is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


_TABLES = "_tidemark_path"


def materialize(df: DataFrame, name: str, compression: str = "zstd", shrink: int = 1) -> DataFrame:
    """Write df as Parquet to the shared folder and read it: lineage ends, every executor sees it.

    A table that is small beside the documents is written by 1/shrink of the shuffle partitions, so
    that it is not scattered over many tiny files. The table is removed by drop(), or when the
    driver's process ends.
    """
    spark = df.sparkSession
    if shrink > 1:
        df = df.coalesce(max(1, partitions(spark) // shrink))
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _TABLES, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote and that no later plan reads."""
    for table in tables:
        _remove(table.sparkSession, getattr(table, _TABLES))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_part(bounds: list[tuple[int, ...]], *columns: str) -> Column:
    """How many of the rising bounds are at or below the row's columns, all long: by bisection.

    The bounds are one array literal for each column, so the plan grows by a number for each bound.
    """
    if not bounds:
        return F.lit(0)
    arrays = [F.expr(f"array({','.join(f'{b[i]}L' for b in bounds)})") for i in range(len(columns))]

    def at_or_below(place: Column) -> Column:
        found = F.lit(True)
        for array, column in reversed(list(zip(arrays, columns, strict=True))):
            bound = F.get(array, place - 1)
            found = (bound < F.col(column)) | ((bound == F.col(column)) & found)
        return found

    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda done, step: F.when((done + step <= len(bounds)) & F.coalesce(at_or_below(done + step), F.lit(False)), done + step).otherwise(done))


def range_ends(rows: DataFrame, column: str, weight: Column, parts: int) -> list[int]:
    """Lower ends of all ranges but the first, rising: approximate quantiles of a long column, in which a row counts 1 + weight times.

    A value that holds several quantiles is listed as often.
    """
    heavy = rows.select(F.explode(F.array_repeat(F.col(column), (weight + 1).cast("int"))).alias("v"))
    return heavy.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function from one RecordBatch to a dict of columns (or None)."""
    small_batches(df.sparkSession)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield record_batch(out, target)

    return df.mapInArrow(run, schema)


def record_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = (columns[f.name] for f in target)
    return pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, target, strict=True)], schema=target)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


_MEMO: dict[str, object] = {}


def memo(kind: str, make):
    """What `make` gave for this kind in this Python process; that of any other kind is let go first.

    Workers serve tasks of many stages. So tasks of one stage share what they have learnt, and a
    worker holds the memo of one stage at a time.
    """
    if kind not in _MEMO:
        _MEMO.clear()
        gc.collect()
        _MEMO[kind] = make()
    return _MEMO[kind]
