"""Tables as Parquet, and the analogues of the document entities among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark prunes columns and pushes filters down into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan."""
    return df.filter(F.col(key) == value)


def parameterised(spark: SparkSession, sf_dir: str, name: str, where: str | None = None, **args) -> DataFrame:
    """A textual query with named parameters over one table; the condition is optional."""
    sql = "SELECT * FROM {source}" + (f" WHERE {where}" if where else "")
    return spark.sql(sql, args=args or None, source=table(spark, sf_dir, name))


def page_slice(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_id, text: the texts of pages p0..p1 of a book, joined by line breaks.

    ``pages``: book_id, page, text. ``ranges``: range_id, book_id, p0, p1. Ranges become page keys, so the join is an equi join.
    """
    keys = ranges.select("range_id", "book_id", F.explode(F.sequence("p0", "p1")).alias("page"))
    rows = keys.join(pages, ["book_id", "page"])
    return rows.groupBy("range_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what is used many times is worked out once, and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
