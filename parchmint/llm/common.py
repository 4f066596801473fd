"""Shared plumbing of the training-data operators: shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512  # rows that become Python objects at once
HOT_SHARE = 1000  # a key of more than one row in HOT_SHARE is hot, so that there are fewer than HOT_SHARE hot ones


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a new one in local mode.

    On a cluster no folder of one machine will do, so that an unset one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_written: list[tuple[str, str | None]] = []  # folder, and the name in the catalog of a bucketed table


def scratch_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    own = f"{name}-{uuid.uuid4().hex}"
    _written.append((f"{shared_dir(spark)}/{own}", own.replace("-", "_") if table else None))
    return _written[-1][0]


def clear_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables that this process wrote, all but the first `keep`, once no DataFrame over them is used any more."""
    n = 0
    while len(_written) > keep:
        where, table = _written.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose written tables are removed at its end: read or write its results inside."""
    before = len(_written)
    try:
        yield
    finally:
        clear_scratch(spark, before)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = session_of(df)
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize, bucketed by key: later groupings by the key read the files as they lie, without an exchange."""
    spark = session_of(df)
    path = scratch_path(spark, name, table=name)
    own = _written[-1][1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "uncompressed").option("path", path).saveAsTable(own)
    return spark.table(own)


def joined_to_unique(left: DataFrame, right: DataFrame, key: str, total: int, spread_by: list[str]) -> DataFrame:
    """left, and the columns of right, null where right lacks the key. right: one row a key, and _n, how many of left's `total` rows have it.

    Hot keys are looked up by broadcast, and their rows are dealt out by spread_by; the other keys meet in an exchange.
    """
    names = [c for c in right.columns if c not in (key, "_n")]
    hot, row = F.col("_n") * HOT_SHARE > total, F.struct(F.lit(True).alias("is"), *names)
    rows = left.join(F.broadcast(right.filter(hot).select(key, row.alias("_hot"))), key, "left")
    part = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread_by), F.lit(HOT_SHARE)) + 1)
    cold = right.filter(~hot).select(key, F.lit(0).cast("long").alias("_part"), row.alias("_cold"))
    found = rows.withColumn("_part", part.cast("long")).join(cold, [key, "_part"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*left.columns, *[F.col(f"_found.{n}").alias(n) for n in names])


def unused(name: str, *columns: list[str]) -> str:
    """name, with underscores behind it until none of the columns has it: for columns beside a user's own."""
    taken = {c.lower() for names in columns for c in names}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices: Spark bounds a batch's bytes, this bounds what becomes Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over slices of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
