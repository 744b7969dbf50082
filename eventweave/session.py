"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch folders made where the session names none, and paths written with the thread that did, by application.
_own: dict[str, str] = {}
_written: dict[str, list[tuple[int, str]]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A UTC session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return (
        builder.master(f"local[{cores}]")
        .appName("eventweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="eventweave-")
        root = _own[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((threading.get_ident(), path))
    return path


def scratch_mark(spark: SparkSession) -> int:
    """A point in what was written, for `clear_scratch`."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, mark: int | None = None) -> None:
    """Deletes what this application wrote to the scratch folder; with a mark, what this thread wrote since. Only once no frame that reads it is needed any more."""
    held, me = _written.get(spark.sparkContext.applicationId, []), threading.get_ident()
    gone = list(held) if mark is None else [x for x in held[mark:] if x[0] == me]
    for x in gone:
        held.remove(x)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
