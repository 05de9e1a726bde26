"""Session helpers: building a session for tests and finding the shared scratch folder.

On a cluster the session is created by whoever submits the job; this module only
reads its settings.  ``spark.checkpoint.dir`` names the shared folder used to cut
lineage; a local folder is chosen only when the setting is absent *and* the
master is local (tests, benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, app: str = "prefspark") -> SparkSession:
    """Session with the settings the library expects (AQE on, UI off, Arrow on)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="prefspark-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/prefspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps column statistics and lets later
    reads prune columns; survives executor loss because the files are shared.  The
    files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.parquet(path)


_PACKAGE_ZIP: str | None = None
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``prefspark`` importable in Python workers (``addPyFile``, once per context).

    Grouped maps and ``mapInPandas`` functions refer to this package's code; on a
    cluster the executors only have it if it is shipped, exactly like
    ``spark-submit --py-files``.
    """
    global _PACKAGE_ZIP
    sc = spark.sparkContext
    app = sc.applicationId  # a new context (new application) must be shipped to again
    if app in _SHIPPED:
        return
    if _PACKAGE_ZIP is None:
        import zipfile

        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        fd, path = tempfile.mkstemp(prefix="prefspark-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for dirpath, _dirs, files in os.walk(pkg_dir):
                if "__pycache__" in dirpath:
                    continue
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        zf.write(full, os.path.relpath(full, root))
        _PACKAGE_ZIP = path
    sc.addPyFile(_PACKAGE_ZIP)
    _SHIPPED.add(app)
