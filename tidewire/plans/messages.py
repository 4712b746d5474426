"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.messages import exactly_once, redelivered
from tidewire.tables import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return redelivered(table(spark, sf, "kafka_schema"))


def p6_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    return exactly_once(table(spark, sf, "kafka_schema").select("msg_id", "msg_partition", "msg_offset", "batch_id", "url", "publishedAt", "source_name"))


def p6_first_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """The copy of each message that was delivered first, by time of delivery, equal times by id."""
    messages = table(spark, sf, "kafka_schema").select("msg_id", "kafka_ts", "url", "publishedAt")
    return exactly_once(messages, ("kafka_ts", "msg_id")).select("msg_id", "kafka_ts")


def p6_copies_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    messages = table(spark, sf, "kafka_schema")
    copies = redelivered(messages).withColumn("again", F.lit(1))
    return (
        messages.select("msg_id", "batch_id")
        .join(copies, "msg_id", "left")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("messages"), F.count("again").alias("copies"))
    )


QUERIES = {"p6_found": p6_found, "p6_exactly_once": p6_exactly_once, "p6_first_delivered": p6_first_delivered, "p6_copies_by_batch": p6_copies_by_batch}

_KEYED = r"""
keyed AS (
  SELECT msg_id, kafka_ts, url, try_cast(CASE WHEN regexp_matches(publishedAt, '(Z|[+-]\d{2}:\d{2})$')
    THEN publishedAt ELSE publishedAt || 'Z' END AS TIMESTAMPTZ) AS moment
  FROM kafka_schema
  WHERE url <> '' AND regexp_matches(publishedAt, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$')
),
again AS (
  SELECT msg_id FROM (SELECT msg_id, row_number() OVER (PARTITION BY url, moment ORDER BY msg_id) AS n FROM keyed WHERE moment IS NOT NULL)
  WHERE n > 1
)"""

SQL = {
    "p6_found": f"WITH {_KEYED} SELECT msg_id FROM again",
    "p6_exactly_once": f"""WITH {_KEYED} SELECT msg_id, msg_partition, msg_offset, batch_id, url, publishedAt, source_name
        FROM kafka_schema WHERE msg_id NOT IN (SELECT msg_id FROM again)""",
    "p6_first_delivered": f"""WITH {_KEYED}, late AS (SELECT msg_id FROM (SELECT msg_id, row_number() OVER (PARTITION BY url, moment ORDER BY kafka_ts NULLS FIRST, msg_id) AS n FROM keyed WHERE moment IS NOT NULL) WHERE n > 1)
        SELECT msg_id, kafka_ts FROM kafka_schema WHERE msg_id NOT IN (SELECT msg_id FROM late)""",
    "p6_copies_by_batch": f"""WITH {_KEYED} SELECT batch_id, count(*) AS messages, count(a.msg_id) AS copies
        FROM kafka_schema k LEFT JOIN again a USING (msg_id) GROUP BY batch_id""",
}
