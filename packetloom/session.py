"""Session construction and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# The JVM does not compile methods above 8000 bytecodes; Spark's default limit would still run
# such generated methods interpreted. Session windows are merged before the shuffle.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass": _STATE_STORE,
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    """One builder for every job: UTC, AQE with skew-join splitting, RocksDB state."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **_RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers, wherever the job was started; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_packetloom_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="packetloom-"), "packetloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)  # the driver serves a copy of it
    sc._packetloom_shipped = True
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, for sessions built elsewhere."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="packetloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _paths.append(path)
    return path


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes the tables stored inside the block at its end: for blocks whose result does not read them any more."""
    begin = len(_paths)
    yield
    hadoop = spark._jsc.hadoopConfiguration()
    for path in _paths[begin:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    del _paths[begin:]


def materialise(df, name: str, **options: str):
    """Write and re-read: cuts lineage in storage every executor can reach. `options` are the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
