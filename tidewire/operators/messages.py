"""Messages that an at-least-once stream delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import instant


def first_copies(df: DataFrame, keys: Sequence[str], keep: str, order: Sequence[str]) -> DataFrame:
    """One row per combination of ``keys``: ``keep`` of the copy that comes first by ``order``, and ``copies``.

    One hash aggregation with ``min_by``. Its partial step runs before the shuffle, so a key that holds a third of
    all rows reaches the final step as one row per map task. An ``order`` of several columns is compared as a struct;
    of one column it is that column, so that the buffer has a fixed width and Spark keeps the hash aggregation.
    Null keys group together as in SQL; filter them before if they mean "no identifier". Ties in ``order`` are the
    caller's to exclude: end it with a unique column. No rows in, no rows out.
    """
    by: Column = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(keep, by).alias(keep), F.count(F.lit(1)).alias("copies"))


def identified(messages: DataFrame) -> DataFrame:
    """Messages that have an identifier: a url that is not empty and a ``publishedAt`` that is a time.

    Adds ``_instant``; a column of that name in ``messages`` is replaced.
    """
    return messages.withColumn("_instant", instant(F.col("publishedAt"))).filter(
        (F.col("url") != "") & F.col("_instant").isNotNull()
    )


def redelivered(messages: DataFrame) -> DataFrame:
    """``msg_id`` of every copy of a message but the first (the smallest ``msg_id``).

    The kept ids are taken away by an anti join on the unique ``msg_id``, never by a join on the skewed key.
    Messages without an identifier are never copies.
    """
    known = identified(messages.select("msg_id", "url", "publishedAt"))
    kept = first_copies(known.select("msg_id", "url", "_instant"), ["url", "_instant"], "msg_id", ["msg_id"])
    return known.select("msg_id").join(kept.select("msg_id"), "msg_id", "left_anti")


def exactly_once(messages: DataFrame, order: Sequence[str] = ("msg_id",)) -> DataFrame:
    """``messages`` with one copy of each; rows without an identifier stay, as nothing shows that they are copies.

    The copy kept is the first by ``order``: one hash aggregation of ``min_by`` over all columns as a struct, whose partial
    step keeps one row a key and task. By default that is the smallest ``msg_id``, which numbers messages in order of
    arrival and is unique, so that a delivery time before it would add nothing; where delivery time decides, as
    ``("kafka_ts", "msg_id")``, the unique id breaks ties. All columns are kept. Empty input gives empty output.
    """
    columns = messages.columns
    known = identified(messages)
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = known.groupBy("url", "_instant").agg(F.min_by(F.struct(*columns), by).alias("_first")).select("_first.*")
    named = F.coalesce((F.col("url") != "") & instant(F.col("publishedAt")).isNotNull(), F.lit(False))
    return first.unionByName(messages.filter(~named))
