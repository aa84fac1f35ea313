"""Storage that outlives an executor and goes with its session, and joins by a checked size."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SENT = 200_000  # rows of a side up to which it is broadcast
MOST_SENT_BYTES = 64 << 20  # and their bytes

_made: dict[str, set[str]] = {}  # folders of each application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _owned(spark: SparkSession, folder: str) -> None:
    """From now on the folder is this application's: it goes when the context stops, or else when the JVM ends."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _made:
        _made[app] = set()
        stop = context.stop

        def clean_and_stop() -> None:
            for made in sorted(_made.pop(app, ())):
                delete(spark, made)
            stop()

        context.stop = clean_and_stop
    _made[app].add(folder)
    path, files = _path(spark, folder)
    files.deleteOnExit(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the session stops."""
    folder = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    _owned(spark, folder)
    return folder


def there(spark: SparkSession, path: str) -> bool:
    found, files = _path(spark, path)
    return files.exists(found)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared folder and later stages read them from there. They go with the session, or by `forget`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jsc.sc()
    if not jvm.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        _owned(spark, jvm.getCheckpointDir().get())
    kept = df.checkpoint(eager=True)
    if folder := _checkpoint_of(kept):
        _owned(spark, folder)
    return kept


def _checkpoint_of(df: DataFrame) -> str | None:
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    found = plan.rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def forget(df: DataFrame) -> None:
    """Remove the rows of a settled table that nothing reads any more."""
    if folder := _checkpoint_of(df):
        delete(df.sparkSession, folder)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the session sets for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written by columns to the shared folder, and read from there: for wide rows of which later stages read some columns."""
    folder = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def gathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in as few partitions as its number of rows asks for, so that short tables don't keep hundreds of tasks and files. No row moves."""
    return df.coalesce(max(1, min(tasks(df.sparkSession), -(-rows // each))))


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value, about."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(value) * 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.octet_length(F.array_join(value, "        "))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(value)))
    return F.lit(8)


def sent(df: DataFrame, most: int = MOST_SENT, most_bytes: int = MOST_SENT_BYTES) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows and about `most_bytes` bytes; else it is joined as it comes."""
    size = sum((F.coalesce(_bytes(f.name, f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(16)).cast("long")
    rows, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and total <= most_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them by the keys; anything else as it is.

    A small table in one file would keep one core busy. A large one has splits enough and doesn't move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, tasks(df.sparkSession)), *keys)
