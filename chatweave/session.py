"""Session set-up and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this library is designed around: adaptive execution
# (runtime broadcast only from measured shuffle sizes, skew-join splitting,
# partition coalescing) and Arrow transfer for the pandas-backed operators.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle partitions to the advisory size, not to the core count
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of operators that cut lineage are removed once the
    # checkpointed DataFrame is garbage-collected on the driver
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "chatweave",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the recommended settings.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``local[N]`` with ``shuffle_partitions`` near the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests, bench) without
    the setting gets a fresh folder of its own; a cluster must name one, since
    a machine-local folder is not visible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)"
            )
        root = tempfile.mkdtemp(prefix="chatweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df):
    """Compute ``df`` once into the shared checkpoint folder and continue
    from there (a reliable checkpoint: it survives executor loss, unlike a
    local one). Used where a plan would otherwise be evaluated several
    times: a range partitioner samples its input in a job of its own, and
    both passes of a two-pass operator read the same input."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def join_bounded(left, right, on: list[str], how: str = "left", max_rows: int = 10_000):
    """Join with a broadcast of ``right`` only if it has at most ``max_rows``
    rows (counted; ``right`` should be materialised), else as a shuffle join."""
    from pyspark.sql import functions as F

    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark's file systems have it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``chatweave`` importable in Python workers.

    Workers inherit the driver's PYTHONPATH but not a ``sys.path`` edit made
    at run time; in that case the package is zipped once and added with
    ``addPyFile`` (the driver serves it to every executor).
    """
    if spark.conf.get("chatweave.shipped", "false") == "true":
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    on_path = any(
        os.path.abspath(p or ".") == parent
        for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)
        if p
    )
    if not on_path:
        out = os.path.join(tempfile.mkdtemp(prefix="chatweave-pkg-"), "chatweave.zip")
        with zipfile.ZipFile(out, "w") as zf:
            for root, _dirs, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        zf.write(full, os.path.relpath(full, parent))
        spark.sparkContext.addPyFile(out)
    spark.conf.set("chatweave.shipped", "true")
