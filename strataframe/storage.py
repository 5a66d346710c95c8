"""Shared-folder helpers: working folders, small JSON manifests and atomic commits through Hadoop's file systems."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_used: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: as the session names it, else one that this module knows to be shared.

    Where none is set, a session with a `local` master, all of whose tasks run on this machine, gets a private temporary
    folder; any other one a folder on the cluster's default file system. RuntimeError where that is a machine's own disk.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    app = context.applicationId
    if app not in _local:
        if context.master == "local" or context.master.startswith("local["):
            kept = tempfile.TemporaryDirectory(prefix="strataframe-")
            atexit.register(kept.cleanup)
            _local[app] = f"file://{kept.name}"
        else:
            base = str(context._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(context._jsc.hadoopConfiguration()).toString()).rstrip("/")
            if base.startswith("file:"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
            _local[app] = f"{base}/tmp/strataframe"
    return _local[app]


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root, in a folder of this application that is removed when it ends."""
    folder = f"{shared_root(spark)}/strataframe-{spark.sparkContext.applicationId}"
    if folder not in _used:
        fs, at, _ = _fs(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _used.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The JSON object stored at path, or None if there is no such file."""
    fs, at, jvm = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def commit_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a new file under a temporary name and rename it: a reader sees all of it or nothing.

    The rename never overwrites, which the file system itself sees to where it can: an existing file belongs to another
    writer, and FileExistsError is raised.
    """
    fs, at, jvm = _fs(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs.mkdirs(at.getParent())
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode("utf-8")))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(at), keep)
    except Exception as e:
        fs.delete(temp, False)
        if fs.exists(at):
            raise FileExistsError(path) from e
        raise


def newest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """(number, content) of the manifest N.json with the greatest number in folder; None if there is none."""
    numbers = manifests(spark, folder)
    return (numbers[-1], read_json(spark, manifest_path(folder, numbers[-1]))) if numbers else None


def manifests(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests in folder, ascending as numbers."""
    return sorted(int(n[:-5]) for n in list_names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def manifest_path(folder: str, number: int) -> str:
    return f"{folder}/{number}.json"


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, at, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write df to path and read it back: cuts the lineage at files that outlive any executor."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table name of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
