"""File and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """``df`` as Parquet; ``files`` only where a consumer needs that many, as it limits the tasks that write."""
    (df.coalesce(files) if files else df).write.mode(mode).parquet(path)


def append_documents(df: DataFrame, path: str) -> None:
    """Rows appended to the stored documents with the time of insertion."""
    df.withColumn("inserted_at", F.current_timestamp()).write.mode("append").parquet(path)


def collections(spark: SparkSession, folder: str) -> list[str]:
    """The names of the stored tables under ``folder``, on any file system that Spark reads; none if it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def purge(spark: SparkSession, path: str, confirm: bool = False) -> int:
    """Overwrites the stored documents with none and returns how many there were; only with ``confirm``."""
    if not confirm:
        raise ValueError("purging deletes all documents; pass confirm=True")
    stored = spark.read.parquet(path)
    n, schema = stored.count(), stored.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def json_messages(df: DataFrame) -> DataFrame:
    """Rows as messages: one JSON text in ``value``, as a stream topic holds them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def parse_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """Messages (``value``) as columns; what is no JSON gives nulls."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")


def with_defaults(articles: DataFrame) -> DataFrame:
    """The five basic fields of articles with a url, 'N/A' where one is missing; ``source`` may be a struct with a name."""
    source = F.col("source.name") if "source" in articles.columns else F.col("source_name")
    fields = [F.coalesce(c, F.lit("N/A")).alias(c) for c in ("title", "description", "url", "publishedAt")]
    return articles.filter(F.col("url").isNotNull() & (F.col("url") != "")).select(*fields, F.coalesce(source, F.lit("N/A")).alias("source_name"))
