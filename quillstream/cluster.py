"""What runs need of a cluster: the shared folder, and the package on the executors."""

from __future__ import annotations

import contextlib
import io
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only in local runs that name no shared folder, such as tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_shipped: set[str] = set()
_scopes: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder, which all executors share; an error on a cluster without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    return f"{root.rstrip('/')}/quillstream"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder path in the shared folder, below that of the temporary tables if there are any."""
    return "/".join([shared_root(spark), *_scopes[-1:], f"{what}-{uuid.uuid4().hex[:12]}"])


@contextlib.contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that are materialised inside are removed at the end: write results elsewhere before."""
    _scopes.append("/".join([*_scopes[-1:], f"run-{uuid.uuid4().hex[:12]}"]))
    try:
        yield
    finally:
        remove(spark, f"{shared_root(spark)}/{_scopes.pop()}")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file on any file system that Spark reads; it appears whole or not at all, where renaming is atomic."""
    fs, place = _file_system(spark, path)
    aside = place.suffix(f".{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(aside)
    out.write(bytearray(content))
    out.close()
    if not fs.rename(aside, place):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _file_system(spark, path)
    source = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, place = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for the operators that run Python there, through the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "quillstream").rglob("*.py")):
            z.write(f, f.relative_to(root))
    # Not below temporary tables: executors that join later read it too.
    target = f"{shared_root(spark)}/code-{uuid.uuid4().hex[:12]}/quillstream_code.zip"
    write_bytes(spark, target, packed.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
