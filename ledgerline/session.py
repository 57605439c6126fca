"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Static settings, only at session build time. Python call-site capture for
# DataFrame error messages is off: it costs about a dozen driver round trips per
# DataFrame/Column call while plans are built.
BUILD_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Runtime settings a reporting job wants on any cluster: runtime re-planning,
# skew splitting, partition coalescing, UTC wall clock.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffle width)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**BUILD_CONF, **JOB_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_conf(spark: SparkSession) -> SparkSession:
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)
    return spark


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block shuffle files go with the statement that made them, not when the driver happens to collect its garbage.

    The setting is the session's: statements of other threads meanwhile free theirs too. A
    DataFrame that is run again makes its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it, to shared storage; without it this
    raises. Only a local master (tests, local runs) gets a local folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """``path`` qualified as Spark qualifies it, and its filesystem."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.makeQualified(hpath), filesystem


def delete_path(spark: SparkSession, path: str) -> None:
    target, filesystem = hadoop_path(spark, path)
    filesystem.delete(target, True)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    target, filesystem = hadoop_path(spark, path)
    stream = filesystem.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with this text unless it is there; False if somebody else created it.

    The text is written under another name and then takes the path's: a hard link on a
    local filesystem, elsewhere a rename, which HDFS refuses for a name that is taken. Object
    stores without such a rename need one publisher at a time.
    """
    target, filesystem = hadoop_path(spark, path)
    draft, _ = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = filesystem.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if target.toUri().getScheme() != "file":
        created = not filesystem.exists(target) and filesystem.rename(draft, target)
    else:
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            created = True
        except FileExistsError:
            created = False
    if filesystem.exists(draft):
        filesystem.delete(draft, False)
    return bool(created)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``; what stood there goes only once the new one is in place."""
    source, filesystem = hadoop_path(spark, new)
    target, _ = hadoop_path(spark, path)
    old, _ = hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/_replaced-{uuid.uuid4().hex}")
    held = filesystem.exists(target)
    if held and not filesystem.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not filesystem.rename(source, target):
        if held:
            filesystem.rename(old, target)
        raise OSError(f"could not move {new} to {path}")
    if held:
        filesystem.delete(old, True)


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerline`` importable in the Python workers, once per application.

    Only the workbook operators run Python on executors; functions defined in
    this package are pickled by reference, so the workers need the package. It
    is zipped and handed to ``addPyFile``, which distributes it with the job.
    The zip is a driver-side code artifact that Spark itself ships to every
    executor; no data is stored there.
    """
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="ledgerline-pyfiles-")
        archive = shutil.make_archive(os.path.join(out, "ledgerline"), "zip", root_dir=os.path.dirname(pkg_dir),
                                      base_dir=os.path.basename(pkg_dir))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
