"""Session helpers: sane defaults for local runs, cluster settings untouched."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: (session, folder) of the tables written by ``written`` and not yet released.
_scratch: list[tuple[SparkSession, str]] = []
#: (session, key) -> table, of ``artefact``.
_artefacts: dict[tuple, DataFrame] = {}
#: Applications whose workers have the package.
_shipped: set[str] = set()


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "quire") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master and resources come from spark-submit; only the
    SQL knobs below are set here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it (shared storage); only when it is unset (local tests)
    do we pick a scratch folder of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3); "
                             "a machine-local folder does not survive a lost executor")
        d = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("QUIRE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that they need no copy of
    their own: a zip file of its sources, distributed by Spark."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quire-package-"), "quire_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("quire", os.path.relpath(os.path.join(folder, n), root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, released by ``release_scratch``."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    if not _scratch:
        atexit.register(_release_at_exit)
    path = f"{root}/quire-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def artefact(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table written once per session and key, and read by every later caller."""
    found = _artefacts.get((id(spark), key))
    if found is None:
        found = _artefacts[id(spark), key] = written(build(), str(key[-1]))
    return found


def release_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``written`` and ``artefact`` made in this session."""
    for k in [k for k in _artefacts if k[0] == id(spark)]:
        del _artefacts[k]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [x for x in _scratch if x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(entry[1])
        p.getFileSystem(conf).delete(p, True)
        _scratch.remove(entry)


def _release_at_exit() -> None:
    for s in {id(s): s for s, _ in _scratch}.values():
        try:
            release_scratch(s)
        except Exception:       # the session may have been stopped before the interpreter ends
            pass
