"""Session helpers: table loading, reliable stage tables, checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_STAGES: list[tuple[object, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "velatura") -> SparkSession:
    """A session for tests and the benchmark; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table of a data folder, pruned to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the scan has fewer partitions than there are cores.

    For work that costs far more a row than moving the row does, on inputs of a few
    files. A scan with enough partitions is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for stage tables: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is this machine (tests, a laptop) a temporary
    folder is made, once per application. On a cluster an unset folder is an error: each
    executor would write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not base and not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
            raise ValueError(f"spark.checkpoint.dir isn't set; on {master} it must name a folder that all executors share")
        _OWN_DIR[app] = f"{base or 'file://' + tempfile.mkdtemp(prefix='velatura-')}/velatura-{uuid.uuid4().hex}"
    return _OWN_DIR[app]


def path_of(spark: SparkSession, path: str):
    """(file system, path object) of Hadoop for a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is missing."""
    fs, p = path_of(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _drop(spark_jvm, path: str) -> None:
    jvm, conf = spark_jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def drop_stages() -> None:
    """Delete the stage tables written so far (also runs at exit)."""
    while _STAGES:
        try:
            _drop(*_STAGES.pop())
        except Exception:  # the JVM may be gone already
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and later readers
    prune columns and push filters down to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    sc = spark.sparkContext
    _STAGES.append(((sc._jvm, sc._jsc.hadoopConfiguration()), path))
    return spark.read.schema(df.schema).parquet(path)
