"""Where intermediate tables live, and when a table is small enough to broadcast."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows and bytes up to which a lookup table is held as literal rows and broadcast.
SMALL_ROWS = 20_000
SMALL_BYTES = 8 << 20


def local_session(
    app: str, cpus: str = "8", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    named = {"spark.checkpoint.dir": shared} if shared else {}
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config(map=named)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """The folder every executor can reach: ``spark.checkpoint.dir``, if it is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is not None:
        return f"{named.rstrip('/')}/hedonica-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return None


# What this process has written and not deleted yet.
paths: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on one machine without one, in the warehouse folder."""
    folder = shared_dir(spark) or f"{spark.conf.get('spark.sql.warehouse.dir')}/hedonica"
    paths.append(f"{folder}/{name}-{uuid.uuid4().hex}")
    return paths[-1]


def delete(spark: SparkSession, written_paths: list[str]) -> None:
    """Delete what was written, where Spark's own file systems find it."""
    for path in written_paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in paths:
            paths.remove(path)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs a re-read, not a recompute. On one
    machine without a shared folder the rows are kept by Spark, in memory or on disk.
    """
    spark = df.sparkSession
    if shared_dir(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: pa.Table | list[tuple], schema: StructType | str):
    """A table held in the plan itself: no job to read it, and its size is known."""
    if isinstance(rows, list):
        names = [f.name for f in literal_schema(schema).fields]
        rows = pa.table(
            {name: [row[i] for row in rows] for i, name in enumerate(names)},
            schema=to_arrow_schema(literal_schema(schema)),
        )
    return spark.createDataFrame(rows, schema)


def literal_schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def settled(df: DataFrame, name: str, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a lookup table once; also say whether it is proven small.

    Up to ``limit`` rows of ``SMALL_BYTES`` in all become literal rows; a larger table is
    written out whole.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit and rows.nbytes <= SMALL_BYTES:
        return literal_rows(df.sparkSession, rows, df.schema), True
    return written(df, name), False


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: dict[str, str],
    small: bool,
    how: str = "left",
    extra: Column | None = None,
) -> DataFrame:
    """Join a lookup table; NULL matches NULL. Broadcast only if proven small.

    ``keys`` maps columns of ``df`` to columns of ``table``; names must not clash.
    """
    on = reduce(
        lambda a, b: a & b,
        [df[k].eqNullSafe(table[v]) for k, v in keys.items()],
    )
    if extra is not None:
        on = on & extra
    return df.join(F.broadcast(table) if small else table, on, how).drop(
        *[table[v] for v in keys.values()]
    )
