"""Session construction and the shared folder used to cut lineage.

On a cluster, ``spark.checkpoint.dir`` names a shared (HDFS/S3/ABFS) folder.
We read it from the session and only set our own when it is unset, which only
happens in local tests.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from importlib import resources

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.driver.memory": "12g",
}


def get_session(
    master: str | None = None,
    app_name: str = "shelfspark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session, or build one with sane defaults.

    Cluster jobs normally get their session from ``spark-submit``; this helper
    is for tests, the bench and notebooks.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local[..]``, not ``local-cluster``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only when unset on a local master.

    On a cluster a machine-local folder would lose data, so an unset folder is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="shelfspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the cluster's shared checkpoint folder.

    Used for materialised intermediate tables (lineage cuts) and sinks whose
    location the caller did not choose.  ``unique`` appends a random suffix.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = "/".join([base, "shelfspark", *parts])
    if unique:
        path = f"{path}-{uuid.uuid4().hex[:12]}"
    if "://" not in path and is_local(spark):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem (any scheme)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, through the Hadoop FileSystem (any scheme)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of our own, through the Hadoop FileSystem (any scheme)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def complete_versions(spark: SparkSession, root: str, unfinished: bool = False) -> list[str]:
    """Names of the version folders below ``root`` that were finished, oldest first (any scheme); or of all."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if unfinished or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_COMPLETE")))


def mark_complete(spark: SparkSession, path: str) -> None:
    """Make the version folder ``path`` visible to ``complete_versions``."""
    spark.createDataFrame([("ok",)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/_COMPLETE")


def package_fingerprint() -> str:
    """sha1 over this package's source, read from a folder or a zip: a code change names new results."""
    h = hashlib.sha1()

    def add(folder, prefix: str) -> None:
        for entry in sorted(folder.iterdir(), key=lambda e: e.name):
            if entry.is_dir():
                add(entry, f"{prefix}{entry.name}/")
            elif entry.name.endswith(".py"):
                h.update(f"{prefix}{entry.name}".encode())
                h.update(entry.read_bytes())

    add(resources.files(__package__), "")
    return h.hexdigest()


def content_key(*frames) -> str:
    """A key of the rows of ``frames`` (order-independent checksum) and of this package's code.

    One aggregate per frame over the columns it has, whatever the number of files.
    """
    parts = [package_fingerprint()]
    for df in frames:
        h = F.xxhash64(*[F.col(c) for c in df.columns])
        r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        parts.append(f"{df.columns}{tuple(r)}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def materialized(df, name: str):
    """``df`` written as Parquet below the shared folder and read back: computed once, however often it is read."""
    path = shared_dir(df.sparkSession, "tables", name, unique=True)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
