"""A table that grows by commits (S9): versioned folders and a log that names them.

``<path>/data/<name>`` holds the rows of one append, ``<path>/commits/<n>`` the
folders that make up version n.  An append writes its rows first and then its
commit, which is put in place by one rename that fails if version n is already
there; the loser of two appends tries again on top of the winner.  A reader
takes the last commit, so what a failed append leaves behind is never read and
the version before it stays as it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are committed, ascending."""
    jvm, fs = _fs(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _folders(spark: SparkSession, path: str, version: int) -> list[str]:
    if version == 0:
        return []
    jvm, fs = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{version:010d}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Put version ``version`` in place; false if another writer was first."""
    jvm, fs = _fs(spark, path)
    Path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(Path(f"{path}/commits"))
    made, place = Path(f"{path}/commits/.{uuid.uuid4().hex}"), Path(f"{path}/commits/{version:010d}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"folders": folders}).encode()))
    out.close()
    if not fs.exists(place):
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, place, none)  # without OVERWRITE: an error where the place is taken
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
    fs.delete(made, False)
    return False


def append(df: DataFrame, path: str) -> int:
    """Add the rows of ``df`` and return the new version.  Its columns may differ from those before."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    while True:
        last = max(versions(spark, path), default=0)
        if _commit(spark, path, last + 1, [*_folders(spark, path, last), name]):
            return last + 1


def rewrite(spark: SparkSession, path: str) -> int:
    """Put all rows of the last version into one folder, as a version of its own."""
    while True:
        last = max(versions(spark, path), default=0)
        name = uuid.uuid4().hex
        read(spark, path, last).write.parquet(f"{path}/data/{name}")
        if _commit(spark, path, last + 1, [name]):
            return last + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the last); a column that an append did not have is null in its rows."""
    have = versions(spark, path)
    version = max(have, default=0) if version is None else version
    if version not in have:
        raise FileNotFoundError(f"no version {version} of {path}")
    folders = [f"{path}/data/{n}" for n in _folders(spark, path, version)]
    return spark.read.option("mergeSchema", True).parquet(*folders)


def history(spark: SparkSession, path: str) -> DataFrame:
    """``version`` and ``n_rows`` of every version."""
    found = [read(spark, path, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n_rows")) for v in versions(spark, path)]
    out = spark.createDataFrame([], "version int, n_rows long")
    for f in found:
        out = out.unionByName(f)
    return out
