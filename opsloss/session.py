"""SparkSession construction and the shared (cluster-visible) work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Applied at build time and, where they are
# runtime SQL confs, re-applied to an existing session by ``configure``.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Test tables store naive timestamps; keep them naive end to end.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "opsloss",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the data (AQE coalesces small ones).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SQL_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    # Call-site capture for DataFrame error messages inspects the Python stack
    # and calls the JVM on every column function; a debugging aid that costs
    # about half of plan-construction time. Pass it in ``extra`` to turn it on.
    conf["spark.python.sql.dataFrameDebugging.enabled"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session built elsewhere."""
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can see, under ``spark.checkpoint.dir``.

    The cluster names the shared folder in ``spark.checkpoint.dir``; it is
    read from the session. Only when it is unset (local tests, the smoke
    driver) a scratch folder is created and registered as the checkpoint
    dir, so ``DataFrame.checkpoint()`` and streaming checkpoints land there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = _FALLBACK.get("dir")
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="opsloss-shared-")
            _FALLBACK["dir"] = base
            spark.sparkContext.setCheckpointDir(os.path.join(base, "rdd"))
    return os.path.join(base, *parts) if parts else base


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new, unused folder under the shared dir (one per run)."""
    return shared_dir(spark, "opsloss", kind, uuid.uuid4().hex)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem, so it works for any
    cluster file system (HDFS, object stores), not only local disk."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def observed(observation, name: str) -> int:
    """An observed count after its job. Where Spark sees that a frame has no rows it drops the step that
    would count them, and the observation holds nothing: the count is 0."""
    from py4j.protocol import Py4JJavaError

    try:
        return int(observation.get.get(name) or 0)
    except Py4JJavaError as e:
        if "java.lang.AssertionError" not in str(e.java_exception):
            raise
        return 0


_FALLBACK: dict[str, str] = {}
