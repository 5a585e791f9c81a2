"""Per-split CSV scan and sink (S1-S3, S5) and the split manifest.

Texts hold newlines and quotes, so reader and writer share ``multiLine``,
``quote='"'`` and ``escape='"'`` and keep surrounding whitespace.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")

CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop FileSystem ``exists`` (works for local, HDFS, object stores)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def split_paths(data_dir: str, name: str, split: str) -> list[str]:
    """Where split ``split`` of ``name`` may live: the reference layout
    ``{dir}/{name}_dataset/{name}_{split}.csv``, the flat ``{dir}/{name}_{split}.csv``,
    and this package's partitioned sink ``{dir}/{name}_csv/split={split}``."""
    return [os.path.join(data_dir, f"{name}_dataset", f"{name}_{split}.csv"),
            os.path.join(data_dir, f"{name}_{split}.csv"),
            os.path.join(data_dir, f"{name}_csv", f"split={split}")]


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """Raise ``FileNotFoundError`` for the first missing path (S3)."""
    for p in paths:
        if not _fs_exists(spark, p):
            raise FileNotFoundError(p)


def load_csv_map(spark: SparkSession, split_paths_map: dict[str, str], schema: str) -> DataFrame:
    """Read an explicit split -> path map (S2); every path must exist."""
    require_paths(spark, list(split_paths_map.values()))
    out = None
    for split, path in split_paths_map.items():
        df = spark.read.schema(schema).options(**CSV_OPTS).csv(path).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def load_split_csv(spark: SparkSession, data_dir: str, name: str, schema: str) -> DataFrame:
    """Probe train/validation/test and read those that exist, adding ``split``.

    No split at all raises ``FileNotFoundError`` (S3).  The reads are one
    union, so Spark scans them as one job with the explicit schema.
    """
    found = {}
    for s in SPLITS:
        for p in split_paths(data_dir, name, s):
            if _fs_exists(spark, p):
                found[s] = p
                break
    if not found:
        raise FileNotFoundError(f"no split files for {name!r} under {data_dir}")
    return load_csv_map(spark, found, schema)


def write_split_csv(df: DataFrame, data_dir: str, name: str, split_col: str = "split") -> str:
    """One partitioned CSV write, a folder per split (S5); returns the folder."""
    out = os.path.join(data_dir, f"{name}_csv")
    (df.write.mode("overwrite").partitionBy(split_col).options(**CSV_OPTS).csv(out))
    return out


def manifest(df: DataFrame, dataset: str, split_col: str = "split", text_col: str = "text",
             with_label_text: bool = False) -> DataFrame:
    """Manifest rows (S6): dataset, split, rows, characters, source files.

    ``input_file_name`` is collected as a set per split: its size is the
    number of files, not rows.
    """
    return (df.withColumn("_file", F.input_file_name()).groupBy(split_col)
              .agg(F.count(F.lit(1)).alias("num_samples"),
                   F.sum(F.length(text_col)).cast("bigint").alias("num_chars"),
                   F.sort_array(F.collect_set("_file")).alias("files"))
              .withColumn("dataset", F.lit(dataset))
              .withColumn("with_label_text", F.lit(with_label_text)))


def manifest_document(per_split: DataFrame, outdir: str, num_samples: int = -1) -> DataFrame:
    """The one-object manifest (S6): dataset, splits, outdir, files,
    num_samples (the row cap that was asked for, -1 = all), with_label_text,
    plus the rows per split.  One row, aggregated from the per-split table."""
    return per_split.groupBy("dataset", "with_label_text").agg(
        F.sort_array(F.collect_list("split")).alias("splits"),
        F.sort_array(F.flatten(F.collect_list("files"))).alias("files"),
        F.map_from_entries(F.collect_list(F.struct("split", "num_samples"))).alias("rows_per_split"),
    ).select("dataset", "splits", F.lit(outdir).alias("outdir"), "files",
             F.lit(num_samples).alias("num_samples"), "with_label_text", "rows_per_split")


def write_manifest(m: DataFrame, path: str) -> None:
    """Write the (one-row) manifest as JSON."""
    m.coalesce(1).write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str, col: str = "row") -> None:
    """One text line per table row (e.g. the rows from ``mean_std_rows``)."""
    rows.select(col).write.mode("overwrite").text(path)
