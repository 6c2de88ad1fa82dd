"""Session settings and the shared folder for tables that are written once and read many times."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[tuple[str, str], str] = {}
_own_folder: dict[str, str] = {}


def session(name: str = "lodeline", cores: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings the library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="lodeline-")
    return _own_folder[app]


def mounted(spark: SparkSession, path: str) -> str | None:
    """A folder as every executor opens it without Hadoop, or None if it is in another store than the file system."""
    uri = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = uri.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(uri).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


#: Part of the name of every stored table; to be raised when a derived table changes its content.
STORE_VERSION = 1


def written_once(spark: SparkSession, label: str, build: Callable[[], DataFrame], sources: list[DataFrame] | None = None) -> DataFrame:
    """Write ``build()`` to the shared folder on first use; later calls read the same files.

    The files outlive the loss of an executor, and readers still prune columns and push filters down. With ``sources``, the
    tables that it is built from, other sessions find it too, as long as the files of the sources are the same.
    """
    key = (spark.sparkContext.applicationId, label)
    if key not in _written:
        if sources is None:
            path = f"{shared_dir(spark)}/lodeline/{key[0]}/{hashlib.sha256(label.encode()).hexdigest()[:16]}"
            build().write.mode("overwrite").parquet(path)
        else:
            name = hashlib.sha256(repr((STORE_VERSION, label, [fingerprint(s) for s in sources])).encode()).hexdigest()
            path = _stored(spark, f"{shared_dir(spark)}/lodeline/store/{name[:32]}", build)
        _written[key] = path
    return spark.read.parquet(_written[key])


def folder_once(spark: SparkSession, label: str, write: Callable[[str], None]) -> str:
    """Folder of the shared folder that ``write`` fills on first use in this application."""
    key = (spark.sparkContext.applicationId, f"folder:{label}")
    if key not in _written:
        path = f"{shared_dir(spark)}/lodeline/{key[0]}/{hashlib.sha256(key[1].encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"
        write(path)
        _written[key] = path
    return _written[key]


def fingerprint(df: DataFrame) -> tuple:
    """Tells contents apart by the columns and by the paths, sizes and times of the files that are read."""
    files = df.inputFiles()
    if not files:
        return df.schema.json(), None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    sign = listed.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return df.schema.json(), tuple(map(str, sign))


def _stored(spark: SparkSession, home: str, build: Callable[[], DataFrame]) -> str:
    """Folder of the table that ``home``'s manifest names; it is built first where there is none.

    Data go to a folder of their own, and the manifest gets its name when both are whole. Sessions that build side by
    side all read what the manifest names in the end.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    manifest = hadoop.Path(f"{home}/manifest")
    fs = manifest.getFileSystem(spark._jsc.hadoopConfiguration())

    def named() -> str | None:
        if not fs.exists(manifest):
            return None
        path = spark.read.text(str(manifest)).first()["value"]
        return path if fs.exists(hadoop.Path(f"{path}/_SUCCESS")) else None

    path = named()
    if path is None:
        made = f"{home}/data-{uuid.uuid4().hex}"
        build().write.parquet(made)
        draft = hadoop.Path(f"{home}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(made.encode()))
        out.close()
        if fs.exists(manifest) and named() is None:
            fs.delete(manifest, False)  # what it names is gone
        if not fs.rename(draft, manifest):
            fs.delete(draft, False)
        path = named() or made
    return path


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, cutting its lineage there; ``by`` names a column
    of few values whose rows are read apart."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeline/{spark.sparkContext.applicationId}/stage-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.parquet(path)


def storage_memory(spark: SparkSession) -> int:
    """Bytes in which the executors can keep rows; in local mode those of the one process."""
    sc = spark.sparkContext
    status = sc._jsc.sc().getExecutorMemoryStatus()
    most = [status.apply(name)._1() for name in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keys().toSeq())]
    # Without a local master the driver is listed too and runs no tasks; until executors have come it is all there is.
    return sum(most) if sc.master.startswith("local") or len(most) == 1 else sum(most) - _driver_memory(spark)


def _driver_memory(spark: SparkSession) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().memoryManager().maxOnHeapStorageMemory()


def task_count(spark: SparkSession, items: int, per_task: int) -> int:
    """Partitions for work whose cost lies in computation rather than bytes, so that AQE must not merge it."""
    return max(spark.sparkContext.defaultParallelism, -(-items // per_task))
