"""Session helpers: the shared folder of the cluster and the settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strandloom") -> SparkSession:
    """A session for one machine (tests, bench, CLI). Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # else every column operation asks the JVM for its call site
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on its context.

    Only on one machine (master local) and where neither is set a temporary folder is made and registered; a cluster without
    a shared folder is an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "")
    if not base:
        given = sc._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else ""
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class SharedFiles:
    """Small files below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root, spark._jvm.org.apache.hadoop.fs.Path
        self._spark, self._fs = spark, self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """Names of the files and folders in ``folder``, sorted; none if it is not there. Hidden ones are left out."""
        at = self._at(folder)
        if not self._fs.exists(at):
            return []
        return sorted(n for f in self._fs.listStatus(at) if not (n := str(f.getPath().getName())).startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """Write beside and rename, so readers see all of it or nothing. False if it is there and must not be replaced."""
        final, beside = self._at(name), self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(beside)
        out.write(bytearray(text.encode()))
        out.close()
        if replace and self._fs.exists(final):
            self._fs.delete(final, False)
        done = not self._fs.exists(final) and self._fs.rename(beside, final)
        if not done:
            self._fs.delete(beside, False)
        return bool(done)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def shared_files(spark: SparkSession, root: str) -> SharedFiles:
    return SharedFiles(spark, root)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/strandloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote below the shared folder: call it once its results are stored elsewhere."""
    shared_files(spark, shared_root(spark)).delete(f"strandloom/{spark.sparkContext.applicationId}")


_OPEN = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, what is marked as lasting at that of the block around this one, if there
    is one: nothing that outlives the block may read it. The shuffle files of each query inside are deleted when that query
    ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP)
    _OPEN.blocks = blocks = [*getattr(_OPEN, "blocks", []), []]
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        _OPEN.blocks = blocks[:-1]
        spark.conf.set(_CLEANUP, before)
        for path in blocks[-1]:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`scratch` that no frame reads any more."""
    folder, _, name = path.rpartition("/")
    shared_files(spark, folder).delete(name)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files serve every later read of the result, so they go with the application (:func:`clear_scratch`), not with the
    call; inside of :func:`passing` with its block, or with the one around it if they are lasting.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    blocks = getattr(_OPEN, "blocks", [])
    if len(blocks) > lasting:
        blocks[-1 - lasting].append(path)
    writer = df.write.mode("error").option("compression", "zstd")  # hex digits take half their length
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
