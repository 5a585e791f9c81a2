"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir, scratch_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of words of a text; null counts as an empty text."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("bigint")


def held_out(doc_id: str = "doc_id") -> Column:
    """Evaluation fold: crc32 of the id's decimal text is divisible by 5.

    A null id counts as the empty text (crc32 0), so its row is held out.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_digest(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """96 bits that name a (doc_id, text) row; equal rows share them."""
    return [F.xxhash64(id_col, text).alias("_d1"), F.hash(F.lit(7), id_col, text).alias("_d2")]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Used where later steps need only some of the columns, which a checkpoint
    cannot prune, and in loops over joins: a checkpoint keeps Spark's estimate of
    its plan's size, which joins multiply, so that the number's digits double
    with every round until they fill the driver; files have their own size.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``stored`` that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
