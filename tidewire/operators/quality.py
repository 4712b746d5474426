"""Data quality: counters of a table in one pass, and the cleaning that they suggest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewire.functions.enrich import valid_url


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def metrics(df: DataFrame, columns: Sequence[str], url: str = "url", content: str = "content", least_chars: int = 20) -> DataFrame:
    """One row of counters: rows, null or empty values per column, addresses of another form, short texts, distinct and
    repeated addresses.

    Columns that ``df`` lacks are left out, as are the counters that need them. Null addresses aren't of another form.
    """
    out = [F.count(F.lit(1)).alias("rows")]
    for c in (c for c in columns if c in df.columns):
        empty = F.col(c).isNull() | (F.col(c) == "") if isinstance(df.schema[c].dataType, StringType) else F.col(c).isNull()
        out.append(F.count_if(empty).alias(f"empty_{c}"))
    if url in df.columns:
        out += [
            F.count_if(~valid_url(F.col(url))).alias("invalid_urls"),
            F.count_distinct(url).alias("distinct_urls"),
            (F.count(url) - F.count_distinct(url)).alias("repeated_urls"),
        ]
    if content in df.columns:
        out.append(F.count_if(F.char_length(content) < least_chars).alias("short_texts"))
    return df.agg(*out)


def repeated(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most repeated values of ``column``."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.filter("count > 1").orderBy(F.desc("count"), column).limit(n)


def repeats(df: DataFrame, column: str) -> DataFrame:
    """How many values of ``column`` are different and how many repeat another."""
    return df.agg(F.count_distinct(column).alias("distinct"), (F.count(column) - F.count_distinct(column)).alias("repeated"))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order``; rows with a null key stay one, as equal ones.

    The first ids come from an aggregation with a map-side step and select the rows by a semi join on ``order``, which
    is unique, so that a hot key isn't sorted in one task.
    """
    kept = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(kept, order, "left_semi")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    kept = df.groupBy(key).agg(F.max(order).alias(order)).select(order)
    return df.join(kept, order, "left_semi")


def cleaned(df: DataFrame, key: str = "url", order: str = "msg_id", content: str = "content", least_chars: int = 20) -> DataFrame:
    """Rows with an http address, the first of each address, and a text of at least ``least_chars`` characters."""
    return first_rows(df.filter(valid_url(F.col(key))), key, order).filter(F.char_length(content) >= least_chars)


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of ``columns`` that ``df`` has, in that order."""
    return df.select(*[c for c in columns if c in df.columns])


def top_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def merge_content(basics: DataFrame, pages: DataFrame) -> DataFrame:
    """Article data with the scraped content of the same url: the last row of each url on both sides, no empty content."""
    left = last_rows(basics.filter(F.col("url") != ""), "url", "msg_id")
    right = last_rows(pages.filter(F.col("url") != ""), "url", "record_id").select("url", F.col("content").alias("page_content"))
    return left.join(right.filter(F.col("page_content") != ""), "url").select("url", "title", "publishedAt", "source_name", "page_content")
