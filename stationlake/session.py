"""Session helpers.

Library functions never create or reconfigure a session; they take the
caller's.  ``get_session`` is for scripts and tests only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stationlake", quiet: bool = False) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    Master, memory and shuffle partitions stay as spark-submit sets them
    unless asked for.  AQE stays on, so shuffle partitions are coalesced and
    skewed joins split at run time; no operator depends on the session zone
    (NTZ buckets come from the value's own fields, text is parsed with an
    explicit zone).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A rollup over all 38 fields carries ~270 aggregate buffer slots;
        # above the default of 100 the aggregate leaves whole-stage codegen.
        .config("spark.sql.codegen.maxFields", "1000")
    )
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("STATIONLAKE_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if quiet:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and job state.

    The cluster names it in ``spark.checkpoint.dir``; it is never
    overridden.  Only a local-mode session without one (tests, a laptop)
    gets a fresh folder under /tmp; on a cluster a machine-local folder
    would not survive the loss of that machine, so its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (staging and stream state go there)")
    local = tempfile.mkdtemp(prefix="stationlake-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) objects for ``path`` on any file system Spark knows."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = hadoop_path(spark, path)
    return fs.exists(hpath)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder below the checkpoint folder and read
    back: it is computed once, and its lineage ends there."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staging(spark: SparkSession, path: str) -> None:
    """Delete a staging copy once the write that read it has committed."""
    fs, hpath = hadoop_path(spark, path)
    if fs.exists(hpath):
        fs.delete(hpath, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder; its new parent is made first."""
    fs, source = hadoop_path(spark, old)
    target = hadoop_path(spark, new)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} cannot be renamed to {new}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: under another name, then renamed."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs, hpath = hadoop_path(spark, draft)
    out = fs.create(hpath, True)
    out.write(text.encode())
    out.close()
    drop_staging(spark, path)
    rename(spark, draft, path)


def get_text(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if there is none."""
    fs, hpath = hadoop_path(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
