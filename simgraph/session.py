"""Session helpers: a local builder for tests and benches, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "simgraph", **conf: str) -> SparkSession:
    """A single-JVM session; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local master, where driver and executors
    are one process, gets a temporary folder when that setting is absent.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="simgraph-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` if it is stored in fewer files than there are cores to read them, else as it is."""
    return df.repartition(*keys) if len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism else df


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/simgraph/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_ENDINGS: set[str] = set()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy has no lineage, survives lost executors and is compressed, which RDD checkpoints are not.
    What nobody releases is deleted when the application's Python ends.
    """
    spark = df.sparkSession
    root = _scratch_root(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    if root not in _ENDINGS:
        _ENDINGS.add(root)
        atexit.register(cleanup, spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._simgraph_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_simgraph_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application has materialized and not released."""
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        _delete(spark, _scratch_root(spark))


class Scratch:
    """Tables of one run of an operator: deleted when the block ends, but for its results.

    ``table`` cuts lineage, ``result`` does so for what leaves the block, so that nothing read later hangs
    on a deleted table.
    """

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        self._tables.append(out)
        return out

    def adopt(self, df: DataFrame) -> DataFrame:
        """A table that another operator has materialized for this one."""
        self._tables.append(df)
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete one of the tables before the end."""
        self._tables = [t for t in self._tables if t is not df]
        release(df)

    def result(self, df: DataFrame) -> DataFrame:
        return materialize(df)

    def __exit__(self, *_) -> None:
        for t in self._tables:
            release(t)
        self._tables = []
