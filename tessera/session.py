"""Session helpers.

The library never owns the cluster configuration: it reads what the session says
and fills in only what is unset (tests and the local bench).  Iterative operators
cut lineage with ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir``; on a
cluster that folder is the shared one the cluster names, locally a fresh temporary
folder is taken once per session.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tessera") -> SparkSession:
    """Session for tests and the bench (local mode); clusters pass their own."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Make query results independent of the caller's session defaults.

    Only the time zone is forced (timestamps in the test data carry no zone and
    results are compared as wall-clock values); everything else is left alone.
    """
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (pandas kernels refer to
    its helpers by module): zip the package once per application and add it
    with ``addPyFile`` -- the ``--py-files`` mechanism, so Spark copies it to
    every executor."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the "
                           "driver and all executors share")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def hold(df, name: str = "held"):
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and (unlike a cache or ``checkpoint()``) can be deleted
    with ``drop`` as soon as nothing reads it."""
    path = f"{checkpoint_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held_path = path
    return out


def drop(*held) -> None:
    """Delete tables written by ``hold``."""
    for df in held:
        path = getattr(df, "_held_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bucketed(df, keys: list[str], name: str = "bucketed"):
    """Store ``df`` once, bucketed and sorted by ``keys`` into as many buckets as a shuffle has partitions,
    under the checkpoint folder: joins and groupings by the keys read it without an exchange.  Delete
    it with ``drop_bucketed``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessera_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet")
     .option("path", f"{checkpoint_dir(spark)}/tessera/{name}").saveAsTable(name))
    out = spark.table(name)
    out._bucketed = name
    return out


def drop_bucketed(df) -> None:
    """Forget a table of ``bucketed`` and delete its files."""
    spark, name = df.sparkSession, df._bucketed
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tessera/{name}")
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
