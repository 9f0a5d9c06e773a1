"""Spark session defaults tuned for large shuffles, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCALE_CONF = {
    # Runtime re-planning: coalesce tiny shuffle partitions, split skewed ones,
    # and turn sort-merge joins into broadcast joins when a side is measured small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for pandas UDFs: bounded memory per Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # A JSON-LD corpus is millions of small files: a low open cost packs many
    # files into one read task (the 4 MB default allows ~32 per 128 MB split).
    "spark.sql.files.openCostInBytes": "262144",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "subjex") -> SparkSession:
    """Return the active session, or build one with the scale defaults above.

    On a cluster the session already exists and keeps its own settings; only
    unset keys are filled in.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, fault-tolerant
    location there).  Only when the setting is absent on a local master - tests - a
    private folder is created and registered; a cluster without it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="subjex-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``subjex`` importable in Python workers (once per SparkContext).

    Python UDFs refer to their module by name, so workers must import it.  The zip
    is handed to ``addPyFile``: the driver serves it, whatever the shared folder is.
    """
    sc = spark.sparkContext
    if getattr(sc, "_subjex_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith((".py", ".txt")))
    target = os.path.join(tempfile.mkdtemp(prefix="subjex-ship-"), "subjex.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in files:
            zf.write(f, os.path.join("subjex", os.path.relpath(f, pkg)))
    sc.addPyFile(target)
    sc._subjex_shipped = True


#: Inputs of more splits than this are read as they are.
FEW_SPLITS = 8


def spread(df):
    """Round-robin repartition to the cluster's parallelism when a scan has at most
    ``FEW_SPLITS`` splits (a single-row-group file, a non-splittable compressed file), so what
    is moved is bounded by as many splits; a larger table is never shuffled here."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= min(FEW_SPLITS, target - 1):
        return df.repartition(target)
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the checkpoint folder for a written intermediate table.

    Listed for ``drop_scratch``, which also runs when the interpreter ends.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/subjex-scratch/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df, name: str):
    """Cut the lineage: write ``df`` as Parquet to a scratch folder and read it back.

    The files are on the shared folder, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Delete the intermediate tables written so far (results still reading them must be done)."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is only scratch
            return


_SCRATCH: list = []
atexit.register(drop_scratch)
