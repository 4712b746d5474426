"""Streaming jobs: messages to enriched sentences, and windows over events."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions import enrich as E
from tidewire.functions import text as T
from tidewire.functions.times import instant
from tidewire.ml import sentiment


SCORE = "Sentiment_Result"
#: The stored columns of an enriched sentence, in order.
STORED = [
    "publishedAt", "url", "cleaned_title", "cleaned_description", "source", "source_domain", "category", "word_count", "people_mentioned",
    "organizations_mentioned", "locations_mentioned", "project_names", "financial_figures", "dates_mentioned", "topic_label", "sentence", SCORE,
]


def sentences(messages: DataFrame) -> DataFrame:
    """Messages as enriched sentences, one a row, by native expressions; works on streams and batches alike.

    Messages without title or content and texts without sentences give no rows.
    """
    cleaned = messages.filter("title IS NOT NULL AND content IS NOT NULL").withColumns(
        {
            "cleaned_title": T.clean_text(F.col("title")),
            "cleaned_content": T.clean_text(F.col("content")),
            "cleaned_description": T.clean_text(F.col("description")),
        }
    )
    enriched = cleaned.withColumns(
        {
            "source": E.source_outlet(F.col("url")),
            "source_domain": E.source_domain(F.col("url")),
            "category": E.category(F.col("cleaned_content")),
            "word_count": E.word_count(F.col("cleaned_content")),
            "people_mentioned": E.proper_names(F.col("cleaned_content")),
            "organizations_mentioned": E.organisations(F.col("cleaned_content")),
            "locations_mentioned": E.places(F.col("cleaned_content")),
            "dates_mentioned": E.dates(F.col("cleaned_content")),
            "financial_figures": E.money(F.col("content")),
            "project_names": E.project_names(F.col("cleaned_content")),
            "topic_label": F.lit(None).cast("string"),
        }
    )
    keep = ["msg_id", *[c for c in STORED if c not in ("sentence", SCORE)]]
    parts = F.explode_outer(T.sentences_stream(F.col("cleaned_content"))).alias("sentence")  # explode would evaluate them twice, to filter empty lists
    return enriched.select(*[c for c in keep if c in enriched.columns], parts).filter("sentence IS NOT NULL")


def scored(messages: DataFrame, model: PipelineModel) -> DataFrame:
    """``sentences`` with the model's score -2..2 in SCORE: all columns that are stored, on streams and batches alike."""
    out = sentiment.score(model, sentences(messages)).withColumnRenamed("predicted_score", SCORE)
    return out.select("msg_id", *STORED)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes a stream exactly once; without ``every`` it reads what there is and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def event_time(events: DataFrame, column: str = "publishedAt", late: str = "2 days") -> DataFrame:
    """``events`` with ``event_time`` from a text and a watermark; rows without a time are left out."""
    return events.withColumn("event_time", instant(F.col(column))).filter("event_time IS NOT NULL").withWatermark("event_time", late)


def deduplicated(messages: DataFrame, late: str = "2 days") -> DataFrame:
    """Messages once each by url and time while the watermark holds; state is dropped behind it."""
    return event_time(messages.filter("url <> ''"), late=late).dropDuplicatesWithinWatermark(["url", "event_time"])


def windowed(events: DataFrame, window: Column, key: str) -> DataFrame:
    """Counts per window and key; ``window`` is a tumbling, sliding or session window over ``event_time``."""
    return events.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def tumbling(events: DataFrame, key: str, size: str = "1 day") -> DataFrame:
    return windowed(events, F.window("event_time", size), key)


def sliding(events: DataFrame, key: str, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return windowed(events, F.window("event_time", size, step), key)


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    return windowed(events, F.session_window("event_time", gap), key)
