"""Folders that the driver and all executors see, through the file systems that Spark itself reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or what was given to setCheckpointDir().

    Where neither is set, local masters (tests, a laptop) get one temporary folder per application; on a cluster, whose machines
    would each write to a disk of their own, that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        given = spark._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else ""
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="basalt-")
        found = _own[sc.applicationId]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses. It stays until sweep(), since results are read from it lazily."""
    path = f"{shared_dir(spark)}/basalt-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Delete all scratch paths of this application, once none of its results is needed any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a path; none if it does not exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that is there as a whole or not at all. An existing one is an error."""
    fs, target = _at(spark, path)
    _, part = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    data = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()
