"""Session settings and the shared folder that jobs write their state to."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on; all of them can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Settings a session must be started with. Recording Python call sites for error messages costs more
# than building the plans they describe.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "barlake", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with this library's settings; the cluster supplies the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_CONF, **RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Runtime settings for what is started inside; afterwards they are as before."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session, which has no other machines, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="barlake-")


def run_folder(spark: SparkSession, job: str) -> str:
    """A fresh folder for one run of one job below the shared folder."""
    return f"{shared_folder(spark)}/barlake/{job}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Give the executors this package, once per application: an archive in the shared folder, so that
    Python workers can import it whether or not it is installed on their machines."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as files:
        for module in sorted(root.rglob("*.py")):
            files.write(module, module.relative_to(root.parent))
    place = f"{run_folder(spark, 'library')}/barlake.zip"
    write_file(spark, place, archive.getvalue())
    context.addPyFile(place)
    _shipped.add(context.applicationId)


def write_file(spark: SparkSession, place: str, content: bytes) -> None:
    """Write or replace a small file in any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
