"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


BLAS_ENV = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kestrel") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session instead.

    Every task runs its own NumPy: one BLAS thread per Python worker, so the cores are shared by
    tasks rather than oversubscribed (set the same ``spark.executorEnv.*`` on a cluster)."""
    for k in BLAS_ENV:
        os.environ.setdefault(k, "1")
    b = SparkSession.builder
    for k in BLAS_ENV:
        b = b.config(f"spark.executorEnv.{k}", "1")
    spark = (
        b.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "8g"))
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading ``spark.checkpoint.dir`` from the session.

    Only when the session names none and the master is local (tests) is a private scratch folder
    set; on a cluster executors don't share one, so a session without the setting is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def side_by_side(fn, items, at_once: int = 4) -> list:
    """``fn`` of each item in order; a few run at a time, so that small Spark jobs share the cores."""
    items = list(items)
    with ThreadPoolExecutor(max(1, min(at_once, len(items)))) as pool:
        return list(pool.map(fn, items))


_SHIPPED: set = set()
_ZIP: list = []


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in the Python workers (once per application).

    Per-partition functions reference package code by module, so executors must import it:
    the package is zipped once per driver process and added with ``SparkContext.addPyFile``
    (with spark-submit, ``--py-files`` does the same). The zip is code, not data: it sits on the
    driver only until Spark's own file distribution has copied it to each executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if not _ZIP:
        root = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="kestrel-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for base, _, files in os.walk(root):
                if "__pycache__" in base:
                    continue
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        zf.write(full, os.path.relpath(full, os.path.dirname(root)))
        _ZIP.append(path)
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(app)
