"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library assumes.  UTC keeps timestamp arithmetic identical to
# the SQL oracle; AQE coalesces shuffle partitions and splits skewed joins at
# run time; Arrow is the transport for the two pandas kernels.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "salescope",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and model files.

    On a cluster this must be ``spark.checkpoint.dir`` (a folder every
    executor can reach).  Only a local-mode session without that setting gets
    a private temporary folder, which is what tests use.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="salescope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-path of the shared checkpoint folder."""
    import uuid
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``salescope`` importable in executor Python workers.

    Zips the package once per application and registers it with
    ``addPyFile`` (Spark copies it to every executor).  Needed only by the
    operators that run Python on executors (SHAP and the forecast fit).
    """
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    # On a cluster the package is normally shipped with --py-files; then
    # there is nothing to do.
    shipped = spark.conf.get("spark.submit.pyFiles", "") or ""
    if "salescope" in shipped:
        _SHIPPED.add(app)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, zpath = tempfile.mkstemp(prefix="salescope-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)


_RECORDED: list[list[str]] = []


@contextmanager
def recorded_tables():
    """The paths of the tables that ``materialize`` writes inside the block."""
    paths: list[str] = []
    _RECORDED.append(paths)
    try:
        yield paths
    finally:
        _RECORDED[:] = [p for p in _RECORDED if p is not paths]     # lists may be equal


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables, by the file system that holds them."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def materialize(df, name: str, by: list[str] = ()):
    """Write ``df`` as a Parquet table under the shared checkpoint folder (in
    folders of the columns ``by``) and return a scan of it.

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads the
    files instead of recomputing joins), but the copy is columnar and
    compressed, and each later read prunes columns and pushes filters.
    """
    path = scratch_path(df.sparkSession, name)
    for paths in _RECORDED:
        paths.append(path)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Gives back the shuffle files of what has been written: nothing reads
    them any more, but Spark removes them only when the driver collects garbage,
    by default every 30 minutes."""
    spark._jvm.System.gc()
