"""Spark session and shared-folder helpers.

The library never builds its own cluster configuration for a job it is handed:
query functions take the caller's ``SparkSession``.  ``build_session`` is for
tests, the bench and local runs only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every local run uses.  On a cluster these come from the job
# submission; they are listed here so the local plans look like the cluster ones.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the planner measured to be small; sides of a
    # proven size bound are also hinted explicitly in the operators.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
}


def build_session(master: str | None = None, app: str = "vendora",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (never used on a cluster job)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` is set by the submitter and points at
    shared storage.  Only when it is unset (local tests) do we pick one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        # setting it again would nest one folder in the other
        return named or current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="vendora-ckpt-")
    sc.setCheckpointDir(named)
    return named


_SCRATCH: set = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables.  All of an
    application's are removed when it ends."""
    sc = spark.sparkContext
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vendora-scratch/{sc.applicationId}"
    if sc.applicationId not in _SCRATCH:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SCRATCH.add(sc.applicationId)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application (the usual
    ``--py-files``, for callers who did not pass it)."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="vendora-py-"), "vendora_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("vendora", os.path.relpath(full, top)))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)
